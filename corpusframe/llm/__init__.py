"""Training-data operators: licence scans, audio fingerprints, quality and toxicity
scores, packing, tokenizers, near and exact duplicates, HTML extraction.

Nothing outside this subpackage imports it.
"""
