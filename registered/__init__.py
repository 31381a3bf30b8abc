"""Queries over the supplied tables, each with the SQL text that must give the same rows."""

from registered import extras, forms, history, profiling, scoring

MODULES = [scoring, profiling, forms, history, extras]
