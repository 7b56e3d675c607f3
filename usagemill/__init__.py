"""Usage analytics over agent logs, expressed as Spark DataFrame plans."""
