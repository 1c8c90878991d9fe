"""Composite jobs (P*, X*, E4) and the registry of named driver queries."""
