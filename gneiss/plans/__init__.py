"""gneiss: plans."""
