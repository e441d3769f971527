"""Training-data operators: dedup, language ID, secrets, extraction, search, mixing and packing."""
