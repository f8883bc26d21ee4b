"""Scalar functions and statistics as column expressions."""
