"""Column expressions: text, decisions and contracts."""
