"""Text-risk analytics expressed as Spark DataFrame operators."""
