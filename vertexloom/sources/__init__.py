"""Readers and writers of graph data sets, and graphs derived from relational tables."""
