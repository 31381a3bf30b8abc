"""Readers, archives, file facts and sinks."""
