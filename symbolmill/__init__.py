"""symbolmill: code-index analytics as Spark DataFrame operators."""
