"""Operators of the risk engine."""
