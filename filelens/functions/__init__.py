"""Scalar Column functions (survey §2 C)."""
