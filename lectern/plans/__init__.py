"""Plan-level helpers."""
