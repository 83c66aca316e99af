"""gneiss: functions."""
