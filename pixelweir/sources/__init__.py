"""Message sources and fixtures."""
