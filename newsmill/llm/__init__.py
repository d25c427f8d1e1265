"""Operators for preparing language-model training data.

Nothing else in newsmill imports this package.
"""
