"""Compositions of operators into complete flows."""
