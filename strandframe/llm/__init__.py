"""Operators for preparing language-model training text.

Nothing outside this package imports it; it can be removed as a whole.
"""
