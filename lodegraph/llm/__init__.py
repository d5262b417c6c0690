"""Training-data operators: deduplication, tokens, packing, sharding, search, scoring, extraction.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and ``__spark_entry__.py`` are its callers.
"""
