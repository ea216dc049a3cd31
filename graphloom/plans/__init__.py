"""Iterative plans: fixpoints, and graphs of columns."""
