"""Relational operators: profiles, scores, validation, read paths."""
