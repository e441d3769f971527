"""Relational operators: chunk packing, schemas, validation, scoring, metrics."""
