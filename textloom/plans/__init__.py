"""Extraction plans: extractors, and the engine that runs them over chunks."""
