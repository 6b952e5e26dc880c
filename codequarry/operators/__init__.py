"""DataFrame operators over the corpus tables."""
