"""Batch operators: append, read, retention, delete, router, queue, catalog."""
