"""Operators for preparing training data: filters, dedup, scans, tokens, packing, shards."""
