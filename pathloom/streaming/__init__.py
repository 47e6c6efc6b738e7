"""Structured Streaming: an extension, as the reference only has finished files."""
