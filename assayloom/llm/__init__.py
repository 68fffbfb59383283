"""Operators for preparing training text: scans, deduplication, scoring, decontamination, packing and sharding."""
