"""A PySpark engine for semantic retrieval over rows that carry their own vectors."""
