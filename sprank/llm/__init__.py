"""Training-data operators: deduplication, scoring, search, mixing, packing.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the thin registered
``opN_<name>`` queries and their oracle SQL.
"""
