"""Operators of a training-data pipeline (dedup, tokens, quality, mixing, search).

Nothing else in the package imports this subpackage.  ``queries.py`` holds the thin
registered queries, the other modules hold the general operators.
"""
