"""Streaming of the matchweave library."""
