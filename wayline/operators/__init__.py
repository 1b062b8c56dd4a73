"""Operators over DataFrames of timetables, places, positions and texts; each documents its shuffles."""
