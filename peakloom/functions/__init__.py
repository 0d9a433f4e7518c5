"""Scalar functions over peak columns."""
