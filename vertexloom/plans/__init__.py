"""Symbolic models, and engines that train them."""
