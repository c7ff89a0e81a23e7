"""Training-data operators: packing, token shards, secret scans, similarity
joins, toxicity, mixing, chat formatting, LM scoring, exact dedup and media.

Nothing outside this subpackage imports it.
"""
