"""Scoring that runs the same on tables and on file streams."""
