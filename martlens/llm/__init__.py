"""Operators for preparing training text: quality, language, licences, archives, tokens."""
