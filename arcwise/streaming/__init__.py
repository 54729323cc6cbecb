"""Candidates that arrive as a stream."""
