"""Detection and cleaning of non-content material in document collections, as Spark DataFrame operators."""
