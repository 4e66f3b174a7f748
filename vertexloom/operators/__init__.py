"""Relational operators on graphs, vertex tensors and partitions."""
