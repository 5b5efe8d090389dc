"""Where assets go."""
