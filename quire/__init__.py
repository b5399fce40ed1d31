"""Document-corpus and reading-state analytics as Spark DataFrame transformations."""
