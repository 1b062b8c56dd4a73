"""Structured Streaming: positions and transfers as they come."""
