"""Queries over the given tables, read as timetables, places, positions and pages; with their SQL."""
