"""Operators for preparing language-model training data.

Nothing else in the library imports this package; its queries are in ``queries`` and their SQL in ``sql``.
"""
