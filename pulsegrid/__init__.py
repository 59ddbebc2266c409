"""Physiological and behavioural time-series analytics as Spark jobs."""
