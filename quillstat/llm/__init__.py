"""Training-data operators: tokenisation, packing, quality, dedup, language and licence scans.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds its
queries when it is present.
"""
