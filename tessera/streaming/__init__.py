"""Streaming forms of the service operators; each gives what its batch form gives over the same rows."""
