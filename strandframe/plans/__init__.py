"""Composite analyses and the registered queries."""
