"""Streaming of the show-catalog engine."""
