"""Stored datasets and paths."""
