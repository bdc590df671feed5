"""Composite queries: the user-facing surface."""
