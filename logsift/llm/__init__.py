"""Training-data operators: quality, deduplication, tokens, mixing, scans.

Every operator is a module of its own with a general interface; ``queries``
holds the registered ``opN_<name>`` queries and their SQL.
"""
