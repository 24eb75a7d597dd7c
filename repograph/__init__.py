"""Repository analytics as Spark plans."""
