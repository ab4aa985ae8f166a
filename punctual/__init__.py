"""Spark operators for transit reliability."""
