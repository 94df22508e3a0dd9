"""Operators of the show-catalog engine."""
