"""Operators for preparing training text: deduplication, tokenizing, packing, filtering and archives."""
