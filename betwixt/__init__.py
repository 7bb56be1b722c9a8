"""Graph centrality analytics on PySpark."""
