"""Mutations as a stream, an extension: the dialect itself has no streaming."""
