"""Whole jobs: packing corpora into archives and back."""
