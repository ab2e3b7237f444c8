"""Training-data operators: quality, tokens, language models, deduplication, packing.

Nothing else in the library imports this package.
"""
