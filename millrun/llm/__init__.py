"""Training-data operators: WARC index, dedup, language ID, search, packing, formatting.

Nothing else in the library imports this subpackage; ``queries.REGISTRY`` and
``oracle.ORACLE`` are added by ``__spark_entry__`` only if it can be imported.
"""
