"""Graph, retrieval and usage analytics as lazy PySpark DataFrame operators."""
