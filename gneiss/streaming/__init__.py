"""gneiss: streaming."""
