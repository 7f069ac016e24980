"""Graph-document, text and vector analytics expressed as Spark DataFrame plans."""
