"""News-text analytics as Spark DataFrame operators."""
