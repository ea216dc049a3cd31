"""Scalar and text functions as columns."""
