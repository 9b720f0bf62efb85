"""Batch and streaming Spark jobs over detector hits, tracks and design trials."""
