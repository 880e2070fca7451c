"""Operators of a training-data pipeline: sharding, filters, scoring, deduplication and tokenising.

Nothing outside this subpackage imports it. Every operator takes a DataFrame and names of its id and text
columns, reads only those columns, and returns a new narrow DataFrame, so further columns of the input, whatever
their names, never clash with the result.
"""
