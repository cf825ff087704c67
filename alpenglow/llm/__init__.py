"""Training-data operators: tokenizing, deduplication, search, scoring, packing.

Nothing outside this subpackage imports it; the queries are in :mod:`alpenglow.llm.queries`.
"""
