"""Operators on DataFrames: unions, schema rules, change merges and incremental patterns."""
