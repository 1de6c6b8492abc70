"""Market-information analytics as Spark DataFrame operators."""
