"""Readers of messy files and of columnar tables."""
