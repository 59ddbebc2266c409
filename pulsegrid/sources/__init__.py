"""Readers for device exports and recordings, and writers for results."""
