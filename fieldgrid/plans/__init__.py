"""Whole jobs: many files at once, with a log row for each."""
