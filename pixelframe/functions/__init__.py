"""Scalar and array column helpers shared by the operators."""
