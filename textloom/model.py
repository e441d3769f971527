"""What an extraction is asked for, and what it runs with."""

from __future__ import annotations

from dataclasses import dataclass

from textloom.operators.schema import DEFAULT_SCHEMA, PreparedSchema, prepare

#: What a prompt takes besides its chunk, and input bytes for each token.
PROMPT_TOKENS = 600
BYTES_PER_TOKEN = 3.0


@dataclass(frozen=True)
class Request:
    """One extraction: the JSON Schema of its result, how records end, and how long a generation may be."""

    schema: str = DEFAULT_SCHEMA
    delimiter: str = "\n"
    max_tokens: int = 2048

    def prepared(self) -> PreparedSchema:
        return prepare(self.schema)


@dataclass(frozen=True)
class Config:
    """context: tokens of prompt and output together. enforce_shape: whether a model is told to keep to the schema; output is validated in any case."""

    context: int = 8192
    enforce_shape: bool = True
    max_record_bytes: int = 64 << 20


def byte_budget(context: int, max_tokens: int) -> int:
    """Bytes that a chunk may have, so that its prompt and output fit the context."""
    tokens = context - PROMPT_TOKENS - max_tokens
    if tokens < 1:
        raise ValueError("context is too small for the requested max-tokens")
    return int(tokens * BYTES_PER_TOKEN)
