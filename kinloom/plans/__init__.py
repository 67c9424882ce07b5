"""Operators put together to whole runs."""
