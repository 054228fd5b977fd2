"""Operators that prepare training data: dedup, token counts, packing, mixing, search, PII and quality."""
