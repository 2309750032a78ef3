"""Operators on tables of blobs: profiling, row structure, mining."""
