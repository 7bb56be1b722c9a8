"""Derived graphs and the query catalogue."""
