"""Per-file analysis over a stream of arriving files."""
