"""Column functions and the small helpers that parse single texts."""
