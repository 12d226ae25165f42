"""plans of tallyloom."""
