"""Operators of a training-data pipeline: packing, deduplication, PII, quality filters.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the thin ``opN_<name>`` queries.
"""
