"""Readers of what sources publish: feeds, JSON answers and pages, from files."""
