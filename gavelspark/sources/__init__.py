"""Readers, generated cases, manifests and sinks."""
