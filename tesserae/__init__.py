"""Versioned-content analytics on Spark."""
