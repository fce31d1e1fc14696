"""Operators for large text corpora, each by a method of its own."""
