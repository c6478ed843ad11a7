"""Batch and streaming jobs that turn research-paper page text into a graph, searchable chunks and graded answers."""
