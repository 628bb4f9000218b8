"""Operators that prepare training data: deduplication, quality, extraction, mixing and packing."""
