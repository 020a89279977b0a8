"""Operators of a training-data pipeline: formatting, filtering, deduplication, extraction, archives and packing.

Nothing outside this folder imports it.
"""
