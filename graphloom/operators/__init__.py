"""Operators over node, edge, artifact and log tables."""
