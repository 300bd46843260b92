"""Pipelines over streams, and results as streams."""
