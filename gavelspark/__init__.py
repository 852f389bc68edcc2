"""Content-moderation evaluation and release gating as Spark DataFrame operators."""
