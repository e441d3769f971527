"""The extraction engine: sources to chunks to validated items.

Chunks are tried level by level. All chunks are generated at once; those whose
prompt is too long, or whose output stops at the token limit and isn't JSON, are
cut in two by expressions and their halves make up the next level. So a level is
one job over all chunks, and there are as many levels as a chunk can be halved.
An attempt's path - its chunk's place and then the halves taken - sorts attempts
into the order in which one worker would have made them, each before its halves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.json import add_canonical, elements, is_kind, last_key_wins, once, strict_json, with_json
from textloom.functions.storage import materialize
from textloom.functions.text import n_bytes, trim_space
from textloom.model import Config, Request, byte_budget
from textloom.operators.chunk import chunk_texts, halves, pack, records
from textloom.operators.metrics import attempt_metrics
from textloom.operators.order import numbered
from textloom.operators.schema import PreparedSchema
from textloom.operators.validate import array_violations, message, violations
from textloom.plans.extractors import Extractor

ORDER = ["source_index", "chunk_in_source", "path"]
#: Root keywords whose validity items have one by one; any other needs a look at all items together.
ITEM_KEYWORDS = frozenset(["type", "items"])


class ExtractionError(ValueError):
    """The first failure, in input order."""


class NoInput(ExtractionError):
    """No source has anything but white space."""


@dataclass(frozen=True)
class Extraction:
    """items: source_index, chunk_in_source, path, item_pos, value. attempts: one row per generation, in order of index.

    error: the message of the first failure, or None; then items are those of
    successful attempts before it.
    """

    items: DataFrame
    attempts: DataFrame
    error: str | None
    prepared: PreparedSchema

    def metrics(self) -> DataFrame:
        """One row: the attempts' sums. records_produced and output_bytes are those of the items that stand."""
        of = self.items.agg(F.count("*").alias("records_produced"), F.coalesce(F.sum(n_bytes(F.to_json("value"))), F.lit(0)).alias("_bytes"))
        if self.prepared.is_array:
            # brackets, and commas between items
            size = F.col("_bytes") + F.greatest(F.col("records_produced") - 1, F.lit(0)) + 2
        else:
            size = F.col("_bytes")
        of = of.select("records_produced", size.cast("long").alias("output_bytes"))
        rest = attempt_metrics(self.attempts).drop("records_produced", "output_bytes")
        return rest.join(F.broadcast(of))

    def raise_for_error(self) -> Extraction:
        if self.error is not None:
            raise ExtractionError(self.error)
        return self


class Engine:
    """Extracts from sources: rows source_index, content, of any number; content null counts as empty."""

    def __init__(self, extractor: Extractor, config: Config | None = None):
        self.extractor, self.config, self.closed = extractor, config or Config(), False

    def close(self) -> None:
        """After this, extractions are refused. Closing again does nothing."""
        self.closed = True

    def extract(self, sources: DataFrame, request: Request, packed: bool = False) -> Extraction:
        """Atomic: raises on the first failure. `packed`: sources may be too large to be handled as one row each."""
        return self.attempt(sources, request, packed).raise_for_error()

    def attempt(self, sources: DataFrame, request: Request, packed: bool = False) -> Extraction:
        """Like extract(), but keeps what stands before a failure, and tells it."""
        if self.closed:
            raise ExtractionError("engine is closed")
        last_key_wins(sources.sparkSession)
        prepared = request.prepared()
        if not prepared.is_array:
            return self._object(sources, request, prepared)
        budget = byte_budget(self.config.context, request.max_tokens)
        if not request.delimiter:
            raise ValueError("delimiter must not be empty")
        if packed:
            chunks = pack(records(sources, request.delimiter, max_bytes=self.config.max_record_bytes), request.delimiter, budget)
        else:
            chunks = chunk_texts(sources, request.delimiter, budget)
        return self._array(chunks, request, prepared)

    def tries(self, chunks: DataFrame, request: Request, prepared: PreparedSchema) -> DataFrame:
        """All attempts at `chunks` (source_index, chunk_in_source, text): ORDER, depth, text, outcome, error and the counts.

        outcome is ok, split or failed. Blank halves are left out.
        """
        level, depth, found = chunks.select("source_index", "chunk_in_source", F.lit("").alias("path"), "text"), 0, None
        while True:
            run = self.extractor.run(level, request, self.config, prepared)
            run = with_json(run.withColumn("depth", F.lit(depth)), "raw", "_value")
            half = halves(F.col("text"), request.delimiter)
            overflow = (F.col("failure") == "too_long") | (F.col("failure").isNull() & F.col("_value").isNull() & F.col("hit_limit"))
            split = F.coalesce(overflow, F.lit(False)) & half.isNotNull() if prepared.is_array else F.lit(False)
            run = self._checked(run.withColumn("_halves", F.when(split, half)), prepared)
            outcome = F.when(F.col("_halves").isNotNull(), "split").when(F.col("error").isNotNull(), "failed").otherwise("ok")
            n = F.when(outcome == "ok", F.size(elements(F.col("_value"))) if prepared.is_array else F.lit(1)).otherwise(0)
            run = run.withColumns(
                {"outcome": outcome, "records_produced": n.cast("long"), "input_bytes": n_bytes(F.col("text")), "output_bytes": F.coalesce(n_bytes(F.col("raw")), F.lit(0).cast("long")), "retried": F.lit(depth > 0)}
            )
            run = materialize(run.drop("_value"))
            found = run if found is None else found.unionByName(run)
            again = run.filter("outcome = 'split'")
            if again.isEmpty():
                return found.drop("_halves")
            both = F.array(F.struct(F.lit("0").alias("step"), F.col("_halves.left").alias("half")), F.struct(F.lit("1").alias("step"), F.col("_halves.right").alias("half")))
            parts = again.select("source_index", "chunk_in_source", "path", F.explode(both).alias("p"))
            level = parts.select("source_index", "chunk_in_source", F.concat("path", "p.step").alias("path"), trim_space(F.col("p.half")).alias("text")).filter("text <> ''")
            depth += 1

    def _checked(self, run: DataFrame, prepared: PreparedSchema) -> DataFrame:
        """`run` with error: what is wrong with an attempt's output, or null; null too for one that is split (_halves)."""
        value = F.col("_value")
        usable = F.col("_halves").isNull() & F.col("failure").isNull() & value.isNotNull()
        run = once(run, F.when(usable, violations(value, prepared.schema)), "_found")
        broken = F.when(F.col("failure") == "too_long", F.lit("prompt exceeds the context")).when(F.col("failure").isNotNull(), F.col("failure"))
        broken = broken.when(value.isNull(), F.lit("produced invalid JSON"))
        if prepared.is_array:
            broken = broken.when(~is_kind(value, "array"), F.lit("produced a non-array result"))
        return run.withColumn("error", F.when(F.col("_halves").isNull(), broken.otherwise(message(F.col("_found"))))).drop("_found")

    def _array(self, chunks: DataFrame, request: Request, prepared: PreparedSchema) -> Extraction:
        attempts = numbered(self.tries(chunks, request, prepared), ORDER, "index")
        if attempts.isEmpty():
            raise NoInput("no input")
        first = attempts.filter("outcome = 'failed'").orderBy("index").select("index", "error").first()
        error = f"chunk {first['index']}: {first['error']}" if first else None
        made = attempts if first is None else attempts.filter(F.col("index") <= first["index"])
        # what came out well is JSON, strictly; a lenient parser reads the same from it
        items = made.filter("outcome = 'ok'").select(*ORDER, F.posexplode(elements(F.try_parse_json("raw"))).alias("item_pos", "value"))
        if error is None and isinstance(prepared.schema, dict) and prepared.schema.keys() - ITEM_KEYWORDS:
            broken = array_violations(add_canonical(items.select(F.to_json("value").alias("item")), {"item": "item"}), prepared.schema, "item")
            keywords = sorted(r["keyword"] for r in broken.collect())
            error = f"schema validation: (root): {', '.join(keywords)}" if keywords else None
        return Extraction(items, made, error, prepared)

    def _object(self, sources: DataFrame, request: Request, prepared: PreparedSchema) -> Extraction:
        """The whole input, every source and a line feed after it, as one chunk; it is never split."""
        ordered = F.array_sort(F.collect_list(F.struct("source_index", F.coalesce("content", F.lit("")).alias("content"))))
        whole = F.array_join(F.transform(ordered, lambda s: F.concat(s["content"], F.lit("\n"))), "")
        chunk = sources.agg(trim_space(whole).alias("text")).filter("text <> ''").select(F.lit(0).alias("source_index"), F.lit(0).alias("chunk_in_source"), "text")
        attempts = materialize(self.tries(chunk, request, prepared).withColumn("index", F.lit(1).cast("long")))
        row = attempts.select("error").first()
        if row is None:
            raise NoInput("no input")
        items = attempts.filter("outcome = 'ok'").select(*ORDER, F.lit(0).alias("item_pos"), strict_json(F.col("raw")).alias("value"))
        return Extraction(items, attempts, row["error"], prepared)


def extract_groups(groups: DataFrame, extractor: Extractor, request: Request, config: Config | None = None) -> DataFrame:
    """Object extraction for many inputs at once, each a row source_index, content: source_index, value, error.

    Every row is an input of its own, so nothing is shuffled.
    """
    last_key_wins(groups.sparkSession)
    prepared = request.prepared()
    if prepared.is_array:
        raise ValueError("the schema's root is an array")
    engine = Engine(extractor, config)
    chunks = groups.select("source_index", F.lit(0).alias("chunk_in_source"), F.lit("").alias("path"), trim_space(F.col("content")).alias("text")).filter("text <> ''")
    run = with_json(extractor.run(chunks, request, engine.config, prepared), "raw", "_value")
    checked = engine._checked(run.withColumn("_halves", F.lit(None)), prepared)
    return checked.select("source_index", F.when(F.col("error").isNull(), F.col("_value")).alias("value"), "error")


def extract_each(sources: DataFrame, extractor: Extractor, request: Request, config: Config | None = None) -> DataFrame:
    """Whole extractions of many inputs in one plan, each a row source_index, content: source_index, actual, failure.

    actual is the result as JSON text, null if the extraction failed; failure is then
    the first one's message, with attempts numbered within the input. An input of
    nothing but white space has no row. An input's items become one text, so that
    inputs are to be of bounded size; there may be any number of them.
    """
    last_key_wins(sources.sparkSession)
    prepared = request.prepared()
    if not prepared.is_array:
        return extract_groups(sources, extractor, request, config).select("source_index", F.to_json("value").alias("actual"), F.col("error").alias("failure"))
    engine = Engine(extractor, config)
    attempts = engine.tries(chunk_texts(sources, request.delimiter, byte_budget(engine.config.context, request.max_tokens)), request, prepared)
    attempts = attempts.withColumn("index", F.row_number().over(Window.partitionBy("source_index").orderBy("chunk_in_source", "path")))
    texts = F.array_join(F.transform(elements(F.try_parse_json("raw")), lambda v: F.to_json(v)), ",")
    done = attempts.groupBy("source_index").agg(
        F.min(F.when(F.col("outcome") == "failed", F.struct("index", "error"))).alias("_first"),
        F.array_sort(F.collect_list(F.when(F.col("outcome") == "ok", F.struct("index", texts.alias("t"))))).alias("_parts"),
    )
    parts = F.filter(F.transform("_parts", lambda p: p["t"]), lambda t: t != "")
    done = done.withColumn("_all", F.when(F.col("_first").isNull(), F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))))
    done = once(once(done, F.try_parse_json("_all"), "_value"), F.when(F.col("_value").isNotNull(), violations(F.col("_value"), prepared.schema)), "_found")
    failure = F.coalesce(F.concat(F.lit("chunk "), F.col("_first.index").cast("string"), F.lit(": "), F.col("_first.error")), message(F.col("_found")))
    return done.withColumn("failure", failure).select("source_index", F.when(F.col("failure").isNull(), F.col("_all")).alias("actual"), "failure")
