"""codestrata: code-architecture analytics as Spark DataFrame and SQL plans."""

__version__ = "0.1.0"
