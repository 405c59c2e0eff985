"""Operators for preparing training text: quality, toxicity, deduplication, licences, tokens and packing."""
