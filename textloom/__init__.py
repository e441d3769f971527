"""Schema-validated text extraction, and its evaluation, on Spark."""

__version__ = "0.1.0"
