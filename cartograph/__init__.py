"""cartograph: repository analytics as Spark DataFrame operators."""
