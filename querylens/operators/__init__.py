"""Operators over frames of SQL text."""
