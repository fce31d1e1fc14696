"""Structured Streaming forms of scoring, storing and counting."""
