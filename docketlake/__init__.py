"""Messy published tables to one searchable, deduplicated history, on Spark."""
