"""Whole plans: tracing images to documents, and the catalogue of queries."""
