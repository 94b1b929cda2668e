"""Operators on items, feeds, pages and link graphs."""
