"""Training-data pipeline operators; nothing else in eventloom imports this package."""
