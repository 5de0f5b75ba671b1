"""Self-describing containers and documents as tables."""
