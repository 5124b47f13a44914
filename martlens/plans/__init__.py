"""Catalogue of runnable queries and their SQL equivalents."""
