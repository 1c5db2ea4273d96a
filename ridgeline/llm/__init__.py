"""Operators of a training-data pipeline, each by a named method.  Self-contained:
nothing outside this subpackage imports it."""
