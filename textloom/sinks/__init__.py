"""Where results go: JSON arrays and documents, JSON Lines, reports."""
