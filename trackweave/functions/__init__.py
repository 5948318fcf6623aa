"""Shared column functions and session helpers."""
