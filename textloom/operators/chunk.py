"""Cutting text into records, and packing records into chunks of a byte budget.

Packing is next-fit: a chunk takes records in order until the next one would
exceed the budget; delimiters don't count, and a record over the budget is a chunk
of its own. Where a break falls depends on all breaks before it. For a source in one
row that is a fold over its records; for larger ones see pack(). Sources are never mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from textloom.functions.storage import materialize
from textloom.functions.text import is_blank, n_bytes, split_literal, trim_space
from textloom.operators.order import running_totals

MAX_RECORD_BYTES = 64 << 20


def records(sources: DataFrame, delimiter: str, key: str = "source_index", content: str = "content", max_bytes: int = MAX_RECORD_BYTES) -> DataFrame:
    """Rows key, record_pos, record, n_bytes: the records of each source in order, but the empty ones.

    record_pos counts all records from 0, so that it has gaps. A record of more
    than `max_bytes` raises an error. A null content has no records.
    """
    cut = sources.select(key, F.posexplode(split_literal(F.col(content), delimiter)).alias("record_pos", "record"))
    size = n_bytes(F.col("record"))
    checked = F.when(size > max_bytes, F.raise_error(F.lit("record too long"))).otherwise(F.col("record"))
    return cut.filter("record <> ''").select(key, "record_pos", checked.cast("string").alias("record"), size.alias("n_bytes"))


#: Records that are folded into one list of chunks; these lists are then put together.
STRETCH = 256


def chunk_bounds(sizes: Column, budget: int) -> Column:
    """Array of structs from, to: where each chunk of these record sizes begins and ends, `to` exclusive.

    Adding to an array copies it; so records are folded in stretches, each with a
    short array of its own, and the work is in proportion to the number of records.
    """
    bounds = "array<struct<from:int,to:int>>"
    state = F.struct(F.lit(0).cast("long").alias("cur"), F.lit(0).alias("i"), F.lit(0).alias("from"), F.array().cast(bounds).alias("done"))

    def add(s: Column, size: Column) -> Column:
        full = (s["i"] > s["from"]) & (s["cur"] + size > budget)
        return F.struct(
            F.when(full, size).otherwise(s["cur"] + size).cast("long").alias("cur"),
            (s["i"] + 1).alias("i"),
            F.when(full, s["i"]).otherwise(s["from"]).alias("from"),
            F.when(full, F.array_append(s["done"], F.struct(s["from"].alias("from"), s["i"].alias("to")))).otherwise(s["done"]).alias("done"),
        )

    def add_stretch(s: Column, stretch: Column) -> Column:
        begin = F.struct(s["last"]["cur"].alias("cur"), s["last"]["i"].alias("i"), s["last"]["from"].alias("from"), F.array().cast(bounds).alias("done"))
        # an array of one, so that the fold is made once and used twice
        folded = F.transform(F.array(F.aggregate(stretch, begin, add)), lambda last: F.struct(last.alias("last"), F.array_append(s["all"], last["done"]).alias("all")))
        return F.get(folded, F.lit(0))

    def finish(s: Column) -> Column:
        last = F.array(F.struct(s["last"]["from"].alias("from"), s["last"]["i"].alias("to")))
        return F.concat(F.flatten(s["all"]), F.when(s["last"]["i"] > s["last"]["from"], last).otherwise(F.array().cast(bounds)))

    starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / STRETCH).cast("int"))).otherwise(F.array().cast("array<int>"))
    stretches = F.transform(starts, lambda i: F.slice(sizes, i * STRETCH + 1, STRETCH))
    return F.aggregate(stretches, F.struct(state.alias("last"), F.array().cast(f"array<{bounds}>").alias("all")), add_stretch, finish)


def chunk_texts(sources: DataFrame, delimiter: str, budget: int, key: str = "source_index", content: str = "content") -> DataFrame:
    """Rows key, chunk_in_source, text, n_bytes, n_records, for sources that are one row each.

    All of it is a projection within the source's row: nothing is shuffled. Chunks
    whose text is blank are left out and not counted; the text is trimmed, n_bytes
    is that of the records before. A null content has no chunks.
    """
    parts = F.filter(split_literal(F.col(content), delimiter), lambda r: r != "")
    bounds = chunk_bounds(F.col("_sizes"), budget)
    cut = F.transform("_bounds", lambda b: F.slice(F.col("_parts"), b["from"] + 1, b["to"] - b["from"]))
    chunk = lambda p: F.struct(
        trim_space(F.array_join(p, delimiter)).alias("text"), F.aggregate(p, F.lit(0).cast("long"), lambda a, r: a + n_bytes(r)).alias("n_bytes"), F.size(p).cast("long").alias("n_records")
    )
    rows = sources.select(key, parts.alias("_parts")).withColumn("_sizes", F.transform("_parts", lambda r: n_bytes(r))).withColumn("_bounds", bounds).withColumn("_chunks", F.transform(cut, chunk))
    rows = rows.select(key, F.posexplode(F.filter("_chunks", lambda c: c["text"] != "")).alias("chunk_in_source", "c"))
    return rows.select(key, "chunk_in_source", "c.text", "c.n_bytes", "c.n_records")


#: Bytes of a part, in budgets: a chunk that starts in one ends there or begins its follower near the next one's start.
PART = 16
#: Bytes of a part at least.
LEAST = 1 << 18
#: Records of a stretch, by their numbers; one task at a time puts a stretch's texts together.
TEXTS = 16384


@F.pandas_udf(ArrayType(LongType()))
def _exits(at: pd.Series, follower: pd.Series) -> pd.Series:
    """For each record of a part, where the first chunk after the part starts if one starts at that record; -1 for none."""
    out = []
    for places, after in zip(at, follower, strict=True):
        # a follower is a later record of this part, or lies behind it
        inside = np.searchsorted(places, after)
        found = np.array(after, np.int64)
        for i in range(len(found) - 1, -1, -1):
            if 0 <= found[i] and inside[i] < len(found) and places[inside[i]] == found[i]:
                found[i] = found[inside[i]]
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(ArrayType(LongType()))
def _starts(at: pd.Series, follower: pd.Series, first: pd.Series) -> pd.Series:
    """Which records of a part start chunks if the one at `first` does."""
    out = []
    for places, after, here in zip(at, follower, first, strict=True):
        inside, i, found = np.searchsorted(places, after), int(np.searchsorted(places, here)), []
        while i < len(places):
            found.append(i)
            i = int(inside[i]) if after[i] >= 0 else len(places)
        out.append(np.array(found, np.int64))
    return pd.Series(out)


def _parts(recs: DataFrame, budget: int) -> DataFrame:
    """Rows key, part, and for its records in order at (bytes before), pos (record_pos) and follower.

    The follower is where the next chunk starts if one starts at the record: a search
    in the running sums, done for all records at once by a window over a range of
    bytes. -1 if all that comes fits.
    """
    placed = running_totals(recs, ["key"], F.floor(F.col("record_pos") / 65536), ["record_pos"], {"at": "n_bytes"})
    size = max(PART * budget, LEAST)
    own = F.floor(F.col("at") / size)
    # a part also sees what may follow its last chunk
    seen = F.when((own > 0) & (F.col("at") - own * size <= budget), F.array(own, own - 1)).otherwise(F.array(own))
    cut = placed.withColumn("own", own).withColumn("part", F.explode(seen))
    reach = Window.partitionBy("key", "part").orderBy("at").rangeBetween(Window.currentRow, budget)
    last = F.max(F.struct(F.col("at").alias("at"), (F.col("at") + F.col("n_bytes")).alias("to"))).over(reach)
    follower = F.when(F.col("n_bytes") > budget, F.col("at") + F.col("n_bytes")).when(F.col("last.to") > F.col("at") + budget, F.col("last.at")).otherwise(-1)
    rows = cut.withColumn("last", last).filter("own = part").select("key", "part", F.struct("at", F.col("record_pos").cast("long").alias("pos"), follower.cast("long").alias("follower")).alias("r"))
    return rows.groupBy("key", "part").agg(F.array_sort(F.collect_list("r")).alias("r")).select("key", "part", "r.at", "r.pos", "r.follower")


def _reached(parts: DataFrame, budget: int) -> DataFrame:
    """Rows key, part, first: where the first chunk that starts in a part does.

    That depends on the parts before, each of which leads from the few records that a
    chunk may start at near its beginning to one of a later part. Where the chain from
    a source's first record comes by is found by pointer jumping: with each round the
    jumps are twice as long, so that rounds are the logarithm of the number of parts.
    """
    size = max(PART * budget, LEAST)
    ways = parts.withColumn("way", F.explode(F.arrays_zip("at", _exits("at", "follower").alias("to"))))
    near = (F.col("way.at") == F.get("at", F.lit(0))) | (F.col("way.at") - F.col("part") * size <= budget)
    jumps = materialize(ways.filter(near & (F.col("way.to") >= 0)).select("key", F.col("way.at").alias("at"), F.col("way.to").alias("to")))
    reached = parts.filter("part = 0").select("key", F.lit(0).cast("long").alias("at"))
    rounds = (parts.agg(F.max("part")).first()[0] or 0).bit_length()
    for i in range(rounds):
        here, there = jumps.alias("here"), jumps.alias("there")
        known = reached.alias("known")
        onward = known.join(here, F.col("known.key").eqNullSafe(F.col("here.key")) & (F.col("known.at") == F.col("here.at")))
        reached = materialize(reached.union(onward.select("here.key", "here.to")))
        if i < rounds - 1:
            twice = here.join(there, F.col("here.key").eqNullSafe(F.col("there.key")) & (F.col("here.to") == F.col("there.at")))
            jumps = materialize(twice.select("here.key", "here.at", "there.to"))
    return reached.select("key", F.floor(F.col("at") / size).alias("part"), F.col("at").alias("first")).distinct()


def _fold(delimiter: str):
    """Puts together what lies between the starts of chunks; `opened` is the chunk that a stretch begins in.

    A chunk that may go on in the next stretch, or has begun in one before, is passed on as a fragment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, chunk, held, size, cut = None, None, [], 0, False
        schema = None

        def out(is_fragment: bool):
            return pa.RecordBatch.from_pylist([{"key": stretch[0], "n": chunk, "stretch": stretch[1], "text": delimiter.join(held), "n_bytes": size, "n_records": len(held), "fragment": is_fragment}], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("key", batch.schema.field("key").type), *[(c, pa.int64()) for c in ("n", "stretch")], ("text", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64()), ("fragment", pa.bool_())])
            for row in zip(*[batch.column(c).to_pylist() for c in ("key", "stretch", "record_pos", "opened", "starts", "record", "n_bytes")], strict=True):
                at, pos, opened, starts, record, n = row[:2], *row[2:]
                if at != stretch or starts:
                    if held:
                        yield out(cut or at != stretch)
                    held, size, cut = [], 0, at != stretch and not starts
                    stretch, chunk = at, pos if starts else opened
                if record is not None:
                    held.append(record)
                    size += n
        if held:
            yield out(True)

    return run


def pack(recs: DataFrame, delimiter: str, budget: int, key: str = "source_index") -> DataFrame:
    """Rows like chunk_texts(), for records in rows of their own, so for sources of any size.

    No task goes through a source. Where chunks start is worked out from sizes alone,
    in parts of some PART budgets that are followed up by pointer jumping; texts are then
    shuffled once, by stretches of records, and put together there. Only chunks
    that cross stretches are shuffled again. record_pos is unique in a source; its gaps
    don't matter. A null key is a source of its own. Records of no bytes are none, as in records().
    """
    given = recs.select(F.col(key).alias("key"), F.col("record_pos").cast("long").alias("record_pos"), "record", F.col("n_bytes").cast("long").alias("n_bytes")).filter("n_bytes > 0")
    parts = materialize(_parts(given.select("key", "record_pos", "n_bytes"), budget))
    firsts = _reached(parts, budget).alias("f")
    entered = parts.alias("p").join(firsts, F.col("p.key").eqNullSafe(F.col("f.key")) & (F.col("p.part") == F.col("f.part")))
    found = entered.select(F.col("p.key").alias("key"), F.explode(F.transform(_starts("p.at", "p.follower", "f.first"), lambda i: F.get(F.col("p.pos"), i.cast("int")))).alias("record_pos"))
    stretch = F.floor(F.col("record_pos") / TEXTS).alias("stretch")
    starts = materialize(found.select("key", "record_pos", stretch))
    # a stretch begins in the last chunk that starts before it
    seen = given.select("key", stretch).distinct().select("*", F.lit(None).cast("long").alias("record_pos"))
    latest = starts.select("key", "stretch", "record_pos").union(seen).groupBy("key", "stretch").agg(F.max("record_pos").alias("latest"))
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    heads = latest.select("key", "stretch", (F.col("stretch") * TEXTS - 1).alias("record_pos"), F.max("latest").over(before).alias("opened"), F.lit(False).alias("starts"))
    nothing = [F.lit(None).cast("string").alias("record"), F.lit(0).cast("long").alias("n_bytes")]
    marks = heads.select("*", *nothing).union(starts.select("key", "stretch", "record_pos", F.lit(None).cast("long"), F.lit(True), *nothing))
    texts = given.select("key", stretch, "record_pos", F.lit(None).cast("long"), F.lit(False), "record", "n_bytes")
    # the head is first; the mark of a start is before its record
    ordered = marks.union(texts).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "record_pos", F.col("record").isNotNull())
    kind = recs.schema[key].dataType.simpleString()
    pieces = materialize(ordered.mapInArrow(_fold(delimiter), f"key {kind}, n long, stretch long, text string, n_bytes long, n_records long, fragment boolean"))
    whole = pieces.filter("not fragment").select("key", "n", "text", "n_bytes", "n_records")
    texts_in_order = F.transform(F.array_sort(F.collect_list(F.struct("stretch", "text"))), lambda p: p["text"])
    joined = pieces.filter("fragment").groupBy("key", "n").agg(F.array_join(texts_in_order, delimiter).alias("text"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_records").alias("n_records"))
    kept = whole.union(joined).withColumn("text", trim_space(F.col("text"))).filter("text <> ''").withColumn("one", F.lit(1))
    numbered = running_totals(kept, ["key"], F.floor(F.col("n") / 65536), ["n"], {"chunk_in_source": "one"})
    return numbered.select(F.col("key").alias(key), F.col("chunk_in_source").cast("int").alias("chunk_in_source"), "text", "n_bytes", "n_records")


def halves(text: Column, delimiter: str) -> Column:
    """Struct left, right, of a chunk cut in two; null if it has fewer than two characters and no delimiter.

    It is cut between delimiter-separated parts, the left half having the smaller
    number of them, or else between characters.
    """
    parts = split_literal(text, delimiter)
    middle = F.floor(F.size(parts) / 2).cast("int")
    by_part = F.struct(
        F.array_join(F.slice(parts, F.lit(1), middle), delimiter).alias("left"), F.array_join(F.slice(parts, middle + 1, F.size(parts) - middle), delimiter).alias("right")
    )
    half = F.floor(F.char_length(text) / 2).cast("int")
    by_character = F.struct(F.substring(text, F.lit(1), half).alias("left"), F.substring(text, half + 1, F.char_length(text)).alias("right"))
    return F.when(F.size(parts) > 1, by_part).when(F.char_length(text) >= 2, by_character)


def had_input(chunks: DataFrame) -> bool:
    """Whether any chunk is not blank."""
    return not chunks.filter(~is_blank(F.col("text"))).isEmpty()
