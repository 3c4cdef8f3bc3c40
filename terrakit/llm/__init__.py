"""Operators for preparing training text: dedup, joins, scans, mixing, packing, search."""
