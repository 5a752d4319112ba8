"""graphloom: code-knowledge graph analytics on PySpark."""
