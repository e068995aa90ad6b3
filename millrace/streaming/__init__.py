"""Event-time windows over streams."""
