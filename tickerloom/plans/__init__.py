"""Composite queries and the registered catalogue."""
