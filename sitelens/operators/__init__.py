"""Relational operators over latest states, pages of results, sets and ordered texts."""
