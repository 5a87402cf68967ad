"""Operators of the matchweave library."""
