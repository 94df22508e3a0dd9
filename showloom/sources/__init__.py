"""Sources of the show-catalog engine."""
