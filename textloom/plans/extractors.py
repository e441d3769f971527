"""Extractors: what turns a chunk of text into raw JSON.

An extractor adds columns raw, prompt_tokens, generated_tokens, hit_limit and
failure to chunks that have a column text. failure is null, `too_long` if the
prompt doesn't fit the context, or a message. Chunks are independent of each
other, so that Spark may run them anywhere and again.

Rule, JSON and replay extractors are Spark expressions and joins. A model runs in
mapInArrow, loaded once for each Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from inspect import signature
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.json import elements, strict_json
from textloom.functions.text import n_bytes, split_literal
from textloom.model import BYTES_PER_TOKEN, PROMPT_TOKENS, Config, Request
from textloom.operators.schema import PreparedSchema

SYSTEM = "Answer with JSON only, without comments or markup."
TASK = (
    "Extract data from the input below as JSON that fits the schema. If the schema is an array, give one item for every non-empty "
    "source record, in order: never leave out, summarise, group, combine or deduplicate records, and copy identifiers literally."
)


def prompt(text: Column, schema: str) -> Column:
    return F.concat(F.lit(f"{SYSTEM}\n\n{TASK}\n\nSchema:\n{schema}\n\nInput:\n"), text)


def count_tokens(text: Column) -> Column:
    """Tokens of a text where no tokenizer is given: one for every three bytes begun."""
    return F.ceil(F.octet_length(text) / BYTES_PER_TOKEN).cast("long")


class Extractor(Protocol):
    def run(self, chunks: DataFrame, request: Request, config: Config, prepared: PreparedSchema) -> DataFrame: ...


def first_bytes(text: Column, n: int) -> Column:
    """The characters of `text` that are whole within its first `n` bytes."""
    # a character that is cut becomes one replacement character
    most = F.char_length(F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string")))
    begin = F.substring(text, F.lit(1), most)
    return F.when(F.octet_length(begin) > n, F.substring(text, F.lit(1), most - 1)).otherwise(begin)


def limited(chunks: DataFrame, raw: Column, request: Request, config: Config) -> DataFrame:
    """The extractor's columns for a raw output that is known at once, under the token limits of a model."""
    asked = PROMPT_TOKENS + count_tokens(F.col("text"))
    wanted = count_tokens(F.col("_raw"))
    too_long = asked + request.max_tokens > config.context
    # cut by bytes, as a model stops in the middle of things
    cut = F.when(wanted >= request.max_tokens, first_bytes(F.col("_raw"), int(request.max_tokens * BYTES_PER_TOKEN))).otherwise(F.col("_raw"))
    return chunks.withColumn("_raw", raw).withColumns(
        {
            "raw": F.when(~too_long, cut),
            "prompt_tokens": F.when(~too_long, asked).otherwise(F.lit(0).cast("long")),
            "generated_tokens": F.when(~too_long, F.least(wanted, F.lit(request.max_tokens).cast("long"))).otherwise(F.lit(0).cast("long")),
            "hit_limit": ~too_long & (wanted >= request.max_tokens),
            "failure": F.when(too_long, F.lit("too_long")).when(F.coalesce(F.col("_raw"), F.lit("")) == "", F.lit("generation produced no output")),
        }
    ).drop("_raw")


@dataclass(frozen=True)
class RuleExtractor:
    """One item for every record that matches `pattern`: field -> number of its group, with casts to long, double or boolean."""

    pattern: str
    fields: dict[str, int]
    casts: dict[str, str] = field(default_factory=dict)

    def item(self, record: Column) -> Column:
        columns = []
        for name in sorted(self.fields):
            text = F.regexp_extract(record, self.pattern, self.fields[name])
            columns.append((text.cast(self.casts[name]) if name in self.casts else text).alias(name))
        return F.struct(*columns)

    def raw(self, text: Column, delimiter: str, is_array: bool) -> Column:
        if not is_array:
            return F.when(text.rlike(self.pattern), F.to_json(self.item(text), {"ignoreNullFields": "false"}))
        matching = F.filter(split_literal(text, delimiter), lambda r: r.rlike(self.pattern))
        return F.to_json(F.transform(matching, self.item), {"ignoreNullFields": "false"})

    def run(self, chunks: DataFrame, request: Request, config: Config, prepared: PreparedSchema) -> DataFrame:
        return limited(chunks, self.raw(F.col("text"), request.delimiter, prepared.is_array), request, config)


@dataclass(frozen=True)
class JsonExtractor:
    """Records that are JSON already: each becomes an item as it is; others are left out if not `strict`, else break the output."""

    strict: bool = True

    def run(self, chunks: DataFrame, request: Request, config: Config, prepared: PreparedSchema) -> DataFrame:
        if not prepared.is_array:
            return limited(chunks, F.col("text"), request, config)
        parts = F.filter(split_literal(F.col("text"), request.delimiter), lambda r: r != "")
        kept = parts if self.strict else F.filter(parts, lambda r: strict_json(r).isNotNull())
        return limited(chunks, F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")), request, config)


@dataclass(frozen=True)
class ReplayExtractor:
    """Answers from a table of text and raw, as goldens give them; a text it doesn't know gives no output."""

    answers: DataFrame

    def run(self, chunks: DataFrame, request: Request, config: Config, prepared: PreparedSchema) -> DataFrame:
        known = self.answers.select(F.col("text").alias("_text"), F.col("raw").alias("_answer"))
        joined = chunks.join(known, F.col("text") == F.col("_text"), "left")
        return limited(joined, F.col("_answer"), request, config).drop("_text", "_answer")


class Generation(Protocol):
    """What a model gives for one prompt."""

    raw: str | None
    prompt_tokens: int
    generated_tokens: int
    hit_limit: bool
    failure: str | None


@dataclass(frozen=True)
class ModelExtractor:
    """A language model. `load` gives, once for each Python worker, a function of prompt and max_tokens to a Generation.

    If the function has a parameter called schema, it gets the JSON Schema that its
    output is to be held to, or None if the configuration doesn't enforce a shape.
    """

    load: Callable[[], Callable[..., Generation]]

    def run(self, chunks: DataFrame, request: Request, config: Config, prepared: PreparedSchema) -> DataFrame:
        load, most, schema = self.load, request.max_tokens, prepared.text if config.enforce_shape else None

        def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = load()
            shape = {"schema": schema} if "schema" in signature(model).parameters else {}
            for batch in batches:
                found = [model(p, most, **shape) for p in batch.column("_prompt").to_pylist()]
                columns = {c: batch.column(c) for c in batch.schema.names if c != "_prompt"}
                columns |= {name: pa.array([getattr(g, name) for g in found], kind) for name, kind in ADDED}
                yield pa.RecordBatch.from_pydict(columns)

        given = chunks.withColumn("_prompt", prompt(F.col("text"), prepared.text))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema.fields)
        return given.mapInArrow(generate, f"{kinds}, raw string, prompt_tokens long, generated_tokens long, hit_limit boolean, failure string")


ADDED = [("raw", pa.string()), ("prompt_tokens", pa.int64()), ("generated_tokens", pa.int64()), ("hit_limit", pa.bool_()), ("failure", pa.string())]


def rule_table(rows: DataFrame, text: str, extractor: RuleExtractor) -> DataFrame:
    """The typed columns of a rule over rows that are one record each: no JSON, no Python, only expressions."""
    found = rows.filter(F.col(text).rlike(extractor.pattern)).withColumn("_item", extractor.item(F.col(text)))
    return found.select(*rows.columns, "_item.*")


def typed(items: DataFrame, value: str, schema: object) -> DataFrame:
    """`items` with the VARIANT `value` as columns of the types that its schema implies; only for validated values."""
    from pyspark.sql.types import StructType

    from textloom.operators.schema import spark_type

    kind = spark_type(schema)
    if not isinstance(kind, StructType):
        return items.withColumn("item", F.variant_get(value, "$", kind.simpleString()))
    from textloom.functions.json import member

    return items.select(*[c for c in items.columns if c != value], *[F.variant_get(member(F.col(value), f.name), "$", f.dataType.simpleString()).alias(f.name) for f in kind])


def json_items(rows: DataFrame, text: str) -> DataFrame:
    """One row for each element of the arrays in column `text`: the other columns, item_pos and value."""
    return rows.select(*[c for c in rows.columns if c != text], F.posexplode(elements(strict_json(F.col(text)))).alias("item_pos", "value"))
