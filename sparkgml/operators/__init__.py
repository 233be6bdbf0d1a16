"""Distributed operators: observation, parsing, sinks."""
