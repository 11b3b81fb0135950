"""Operators for preparing training text: quality, toxicity, deduplication, tokens, packing, sharding and joins on likeness.

Nothing else in the library imports this subpackage.  Conventions that hold for all of it: a null text counts as empty, rows may
repeat, extra input columns are ignored unless a function says that it passes them on, and an empty table gives an empty result
of the same columns.
"""
