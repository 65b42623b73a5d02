"""Composite plans: the schema graph, the row graph, and a whole load."""
