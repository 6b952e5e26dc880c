"""Reading, admitting and writing corpora of source files."""
