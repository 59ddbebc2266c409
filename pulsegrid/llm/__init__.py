"""Operators for preparing training text: formatting, encoding, mixing, scoring, searching and deduplication."""
