"""Extraction from streams of files."""
