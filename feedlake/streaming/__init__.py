"""Structured Streaming counterparts of discovery and of the stub lifecycle."""
