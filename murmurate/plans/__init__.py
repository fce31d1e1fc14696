"""Whole jobs and reports, made of the operators."""
