"""wickerloom: a Spark-first engine for recommendation and retrieval data."""

__version__ = "0.1.0"
