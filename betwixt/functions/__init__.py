"""Shared column functions."""
