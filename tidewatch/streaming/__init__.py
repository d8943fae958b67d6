"""Streaming forms of the risk engine."""
