"""Operators for preparing training text: scoring, extraction, deduplication, mixing, packing.

Nothing outside this subpackage imports it.
"""
