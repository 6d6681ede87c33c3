"""Structured Streaming jobs; each keeps the rule of its batch counterpart."""
