"""Operators of a training-data pipeline: counting, filtering, deduplication and packing.

Nothing else in the library imports this subpackage.
"""
