"""streaming of the motion engine."""
