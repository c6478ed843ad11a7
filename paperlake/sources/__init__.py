"""Readers and writers, and the decorated test corpus."""
