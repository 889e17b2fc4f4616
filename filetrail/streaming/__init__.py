"""Structured Streaming: arriving files, matching against everything that came before, a growing graph."""
