"""Panel and time-series analytics as Spark DataFrame operators."""
