"""Claims-operations analytics as Spark DataFrame operators."""
