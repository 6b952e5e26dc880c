"""Source-corpus analytics as Spark DataFrame transformations."""
