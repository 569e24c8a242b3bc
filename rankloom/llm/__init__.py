"""Operators for preparing training text: scans, packing, deduplication, scoring and sharding."""
