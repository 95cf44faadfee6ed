"""Tessera: set-based entity screening, change tracking and compliance analytics on Spark."""
