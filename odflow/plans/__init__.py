"""Composite operations (Q1-Q10, D1) and the registry of named queries."""
