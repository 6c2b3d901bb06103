"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it. ``lithic.llm.catalog`` lists its
queries; each operator module documents its own rules for nulls, empty and
very long texts, ties, repeated rows and empty tables.
"""
