"""Training-data operators: dedup, packing, quality, sharding, BPE, PII, language, toxicity, token files.

Nothing outside this subpackage imports it.
"""
