"""Convergence-group analytics for receptor repertoires on Spark."""
