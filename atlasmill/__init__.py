"""Territorial access analytics as Spark jobs."""
