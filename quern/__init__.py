"""Vector, text and relevance analytics as plain PySpark DataFrame operators."""
