"""Whole plans built from the operators: table profile and assessment."""
