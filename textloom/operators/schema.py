"""JSON Schemas: building, reading, and the Spark types they imply."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import types as T

DEFAULT_SCHEMA = json.dumps(
    {
        "type": "object",
        "properties": {
            "attributes": {"type": "object", "additionalProperties": {"type": ["string", "number", "boolean", "null"]}},
            "content_type": {"type": "string"},
            "summary": {"type": "string"},
            "warnings": {"type": "array", "items": {"type": "string"}},
        },
        "required": ["content_type", "summary", "attributes", "warnings"],
    }
)


def fields_schema(fields: str) -> str:
    """The schema of an array of closed objects whose comma-separated fields are all required strings."""
    names = [name.strip() for name in fields.split(",")]
    if "" in names:
        raise ValueError("field names must not be empty")
    if twice := next((n for i, n in enumerate(names) if n in names[:i]), None):
        raise ValueError(f"duplicate field name {twice!r}")
    item = {"type": "object", "properties": {n: {"type": "string"} for n in sorted(names)}, "required": names, "additionalProperties": False}
    return json.dumps({"type": "array", "items": item})


def choose_schema(schema: str | None = None, fields: str | None = None) -> str:
    """A given schema, else one of given fields (given as empty is an error), else the default."""
    if schema is not None:
        return schema
    return DEFAULT_SCHEMA if fields is None else fields_schema(fields)


def has_array_root(schema: object) -> bool:
    """Whether the root's type is, or lists, array. Whatever isn't an object with such a type has an object root."""
    kind = schema.get("type") if isinstance(schema, dict) else None
    return kind == "array" or isinstance(kind, list) and "array" in kind


@dataclass(frozen=True)
class PreparedSchema:
    """A schema read once: its text, its value, and which kind of plan it needs."""

    text: str
    schema: object
    is_array: bool

    @property
    def item(self) -> object:
        """The schema of one item: of the array's elements, or the whole."""
        return self.schema.get("items", True) if self.is_array else self.schema


def prepare(text: str) -> PreparedSchema:
    """Read and check a schema; whatever is wrong with it is raised here, before any input is read."""
    from textloom.operators.validate import violations
    from pyspark.sql import functions as F

    try:
        schema = json.loads(text)
    except ValueError as e:
        raise ValueError(f"invalid schema: {e}") from None
    if not isinstance(schema, (dict, bool)):
        raise ValueError("invalid schema: neither an object nor a boolean")
    violations(F.col("value"), schema)
    return PreparedSchema(text, schema, has_array_root(schema))


def spark_type(schema: object) -> T.DataType:
    """The Spark type of values that a schema admits; VARIANT where no other type holds them all."""
    if not isinstance(schema, dict) or any(k in schema for k in ("$ref", "anyOf", "oneOf", "allOf", "not", "patternProperties", "prefixItems")):
        return T.VariantType()
    kinds = schema.get("type")
    kinds = {kinds} if isinstance(kinds, str) else set(kinds or ())
    kinds.discard("null")
    if kinds == {"integer", "number"}:
        kinds = {"number"}
    if len(kinds) != 1:
        return T.StringType() if not kinds and schema.get("enum") and all(isinstance(x, str) for x in schema["enum"]) else T.VariantType()
    only = kinds.pop()
    if only == "array":
        return T.ArrayType(spark_type(schema.get("items", True)))
    if only == "object":
        named, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        if named and others is False:
            return T.StructType([T.StructField(k, spark_type(named[k])) for k in sorted(named)])
        return T.MapType(T.StringType(), spark_type(others)) if not named and others is not True else T.VariantType()
    return {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}[only]
