"""Operators of a training-data pipeline: dedup, filters, tokenization, packing.

Nothing outside this subpackage imports it.
"""
