"""Disease-burden analytics as Spark DataFrame operators."""
