"""Training-data operators: mixing, toxicity, deduplication, quality, URL rules,
embedding near-duplicates, sharding, secret scans and SentencePiece.

Nothing outside this subpackage imports it.
"""
