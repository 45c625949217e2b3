"""Structured Streaming jobs over addresses, requests, logs and observations."""
