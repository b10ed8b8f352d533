"""Structural blocks per language: ``content`` column -> array of blocks, within the row.

No extractor shuffles: a file is one row, and its blocks are found inside that row.
"""
