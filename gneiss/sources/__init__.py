"""gneiss: sources."""
