"""Training-data operators: near-dedup, packing, quality, fingerprints, sharding, BPE, ANN, WARC, language ID, repeated passages.

Nothing outside this package imports it.  Each operator lives in its own module; ``queries`` holds
the thin ``opN_*`` queries that apply them to whole tables.
"""
