"""Sources of the matchweave library."""
