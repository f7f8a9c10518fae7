"""Text representation, immune-network clustering and evaluation as Spark DataFrame plans."""
