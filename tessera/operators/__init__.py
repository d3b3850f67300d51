"""Operators on arrays, metadata, layers, codecs, conversion and inspection."""
