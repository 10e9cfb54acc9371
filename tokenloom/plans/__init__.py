"""Facade and the queries built from operators."""
