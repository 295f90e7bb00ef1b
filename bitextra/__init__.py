"""Translation-quality analytics as Spark DataFrame operators."""
