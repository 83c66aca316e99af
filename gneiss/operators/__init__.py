"""gneiss: operators."""
