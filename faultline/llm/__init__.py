"""Training-data operators: packing, deduplication, quality, language and tokenisation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the registered queries and their SQL.
"""
