"""sources of tallyloom."""
