"""Registration analytics as Spark DataFrame operators."""
