"""Spark jobs for making and judging synthetic tables."""
