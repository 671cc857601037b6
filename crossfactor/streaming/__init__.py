"""Event log and live periods."""
