"""Streaming forms of row-wise operators."""
