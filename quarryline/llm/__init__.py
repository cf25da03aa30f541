"""Training-data operators: tokenising, dedup, search, filters, mixing, scoring.

Each module holds one operator with its own interface; ``queries`` derives
the digest tables that ``__spark_entry__`` registers.  Nothing outside this
subpackage imports it.
"""
