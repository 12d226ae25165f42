"""streaming of tallyloom."""
