"""Plans of the show-catalog engine."""
