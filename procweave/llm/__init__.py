"""Operators that prepare training text: tokenizing, deduplication, filtering, packing."""
