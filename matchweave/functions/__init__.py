"""Functions of the matchweave library."""
