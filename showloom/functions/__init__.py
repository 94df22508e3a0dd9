"""Functions of the show-catalog engine."""
