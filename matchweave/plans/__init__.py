"""Plans of the matchweave library."""
