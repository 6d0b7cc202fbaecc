"""Training-data operators: search, quality, language, dedup, tokens and packing.

Nothing outside this folder imports it; the rest of the library works without it.
"""
