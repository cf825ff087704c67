"""Operators on node, edge and pair tables."""
