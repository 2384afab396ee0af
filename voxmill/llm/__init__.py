"""Training-data operators on Spark: extraction, tokenisation, dedup, search, filters, mixing.

Nothing outside this subpackage imports it.
"""
