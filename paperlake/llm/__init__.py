"""Operators for large training-data pipelines, and their registered queries.

Nothing outside this subpackage imports it.
"""
