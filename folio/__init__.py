"""A corpus of documents as relations, on Spark."""
