"""Operators of a training-data pipeline: quality, duplicates, contamination, mixing, sharding, scans and archives.

Nothing else in the library imports this subpackage.
"""
