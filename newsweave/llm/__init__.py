"""Operators for preparing training text: dedup, quality, privacy, mixing and packing."""
