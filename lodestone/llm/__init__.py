"""Operators for preparing large text corpora for language-model training.

Nothing else in the package imports this subpackage.  Each operator is a
module with a general interface; ``queries.py`` holds the thin registered
queries and ``oracles.py`` their SQL.
"""
