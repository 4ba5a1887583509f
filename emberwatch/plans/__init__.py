"""Rules and the end-to-end detection plan."""
