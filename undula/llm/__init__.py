"""Training-data operators: scoring, filtering, deduplication, tokenising, packing and mixing of text corpora.

Nothing outside this subpackage imports it.
"""
