"""Property graphs of symbols, and questions about them, as Spark DataFrame plans."""
