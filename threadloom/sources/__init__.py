"""Input formats."""
