"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage, so it can be removed
without touching the analytics engine.
"""
