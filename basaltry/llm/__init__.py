"""Training-data operators: search, deduplication, scoring, formatting, packing and output.

Nothing outside this folder imports it, so it can be removed as a whole.
"""
