"""Evidence retrieval, answer verification and corpus preparation as Spark DataFrame operators."""
