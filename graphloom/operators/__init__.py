"""Operators over the graph, vector and knowledge tables; each module has its queries and their SQL twins."""
