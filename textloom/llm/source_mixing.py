"""Mixing sources to target weights by Pfair scheduling.

The characters of each source, in a fixed pseudo-random order of its documents,
are cut into blocks of equal size. Every slot of the output takes one block. In
the ideal mix, which has no blocks, all sources flow at once, each in proportion
to its weight, until it is used up; the others then share what it leaves. A
source's i-th block is released when the ideal mix begins it and due when the
ideal mix ends it, rounded outwards to whole slots; among released blocks the one
with the earliest deadline goes first. As the ideal mix puts exactly t blocks into
t slots, this meets all deadlines, so that after any number of slots each source
is less than one block from its share, which is exact: nothing is rounded.

The schedule depends on the sources' sizes and weights alone and is worked out on
the driver, slot by slot. Its length is bounded by SLOTS and the number of sources:
where the corpus has more characters than SLOTS blocks of the usual size, blocks
are made larger. Each document then finds its own slot from its block, in parallel.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Sequence
from fractions import Fraction
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, running_totals

BLOCK_CHARS = 1 << 16
#: Blocks of all sources, about, from which on they grow with the corpus. Bounds the schedule: 8 MB, some ten seconds.
SLOTS = 1 << 21
#: Documents that one window task of the running sums gets, about.
STRETCH_ROWS = 1024
#: Slots of a source that are kept in one row of the schedule.
ROW_SLOTS = 1024
#: Up to so many sources the schedule is broadcast.
BROADCAST_SOURCES = 50_000
ALPHA = 0.5


class _Ideal:
    """The ideal mix: after virtual time v, source k has given min(blocks[k], weights[k] * v) blocks."""

    def __init__(self, blocks: list[int], weights: list[int]):
        self.weights = weights
        ends: dict[Fraction, tuple[int, int]] = {}
        for n, w in zip(blocks, weights, strict=True):
            mass, rate = ends.get(Fraction(n, w), (0, 0))
            ends[Fraction(n, w)] = mass + n, rate + w
        times = sorted(ends)
        self.exact = [(t.numerator, t.denominator) for t in times]
        self.rough = [n / d for n, d in self.exact]
        #: By how many ends have passed: blocks of the sources that have ended, and the weights of the others.
        self.done = list(accumulate((ends[t][0] for t in times), initial=0))
        total = sum(weights)
        self.rate = [total - x for x in accumulate((ends[t][1] for t in times), initial=0)]

    def slot(self, k: int, i: int) -> tuple[int, int]:
        """When source k has given i blocks: that slot rounded down, and up."""
        w = self.weights[k]
        j = bisect_left(self.rough, i / w)
        while j < len(self.exact) and self.exact[j][0] * w < i * self.exact[j][1]:
            j += 1
        while j and self.exact[j - 1][0] * w >= i * self.exact[j - 1][1]:
            j -= 1
        whole, rest = divmod(i * self.rate[j], w)
        return self.done[j] + whole, self.done[j] + whole + (rest > 0)


def _earliest_deadline_first(blocks: list[int], weights: list[int]) -> list[int]:
    """The source of each slot."""
    ideal, out = _Ideal(blocks, weights), []
    ready = [(ideal.slot(k, 1)[1], k, 1) for k in range(len(blocks))]
    heapq.heapify(ready)
    waiting: list[tuple[int, int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (ideal.slot(k, i)[1], k, i))
        _, k, i = heapq.heappop(ready)
        out.append(k)
        if i < blocks[k]:
            heapq.heappush(waiting, (ideal.slot(k, i)[0], k, i + 1))
    return out


def schedule(blocks: Sequence[int], weights: Sequence[float | Fraction]) -> np.ndarray:
    """The source of each slot, for sources of so many blocks. Those without a weight come last, mixed by size.

    Weights are taken exactly as given, whatever their scale; ties go to the source listed first.
    """
    parts = []
    for chosen in ([k for k, n in enumerate(blocks) if n and weights[k] > 0], [k for k, n in enumerate(blocks) if n and not weights[k] > 0]):
        if chosen:
            given = [Fraction(weights[k]) if weights[k] > 0 else Fraction(blocks[k]) for k in chosen]
            scale = lcm(*(w.denominator for w in given))
            found = _earliest_deadline_first([blocks[k] for k in chosen], [int(w * scale) for w in given])
            parts.append(np.array(chosen, np.int64)[np.array(found, np.int64)])
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def tempered(mass: float, alpha: float = ALPHA) -> float:
    """A target weight in proportion to size to the power alpha: below 1 raises small sources."""
    return float(mass) ** alpha


def _rows(who: np.ndarray, ids: np.ndarray) -> pa.Table:
    """The schedule by source: of source id, the slots of blocks nth * ROW_SLOTS and on."""
    by_source = np.argsort(who, kind="stable")
    counts = np.bincount(who, minlength=len(ids))
    starts = np.cumsum(counts) - counts
    source, nth, slots = [], [], []
    for k in np.flatnonzero(counts):
        for row, at in enumerate(range(starts[k], starts[k] + counts[k], ROW_SLOTS)):
            source.append(ids[k])
            nth.append(row)
            slots.append(by_source[at : min(at + ROW_SLOTS, starts[k] + counts[k])])
    return pa.table({"_id": pa.array(source, pa.int64()), "_nth": pa.array(nth, pa.int64()), "_slots": pa.array(slots, pa.list_(pa.int32()))})


def mix(documents: DataFrame, weights: dict | None = None, block_chars: int | None = None, slots: int = SLOTS) -> DataFrame:
    """`documents` with chars, block, slot and offset: sorted by (slot, offset), sources are mixed to their weights.

    `weights` gives each source's target, exactly; by default sizes are tempered.
    Sources without a weight come last. Blocks have `block_chars` characters, by
    default BLOCK_CHARS or, if more, the corpus divided by `slots`. A document belongs
    to the block in which its first character falls, block numbers count within the
    source, and offset is the place of that character in the block. All rows stay.
    Null and empty texts take no room and share the slot of their neighbours; a null
    source is a source of its own; rows that repeat are placed one after another. An
    empty table gives no rows. Columns of the input called chars, block, slot or
    offset are replaced. chars is the text's code points; a caller that needs no more
    of the text doesn't shuffle it. There is no bound on the number of sources: the
    driver holds a number for each, not its name.
    """
    spark = documents.sparkSession
    kept = [c for c in documents.columns if c not in ("chars", "block", "slot", "offset")]
    rows = documents.select(*[F.col(c).alias(f"in_{c}") for c in kept]).withColumn("_chars", F.coalesce(F.char_length("in_text"), F.lit(0)))

    sizes = rows.groupBy("in_source").agg(F.sum("_chars").alias("mass"), F.count("*").alias("rows"))
    given = list((weights or {}).items())
    places = spark.createDataFrame([(s, i) for i, (s, _) in enumerate(given)], "named string, place long")
    sizes = sizes.join(places, F.col("in_source").eqNullSafe(F.col("named")), "left").orderBy("in_source").withColumn("_id", F.monotonically_increasing_id())
    sizes = materialize(sizes.select(F.col("in_source").alias("_name"), "mass", "rows", "place", "_id"))
    found = sizes.select("_id", "mass", "rows", "place").toArrow().sort_by("_id")
    ids, masses = found["_id"].to_numpy(), found["mass"].to_pylist()
    size = block_chars or max(BLOCK_CHARS, -(-sum(masses) // slots))
    targets = [tempered(m) for m in masses] if weights is None else [0 if p is None else given[p][1] for p in found["place"].to_pylist()]
    # the blocks of a source without characters have documents too
    who = schedule([max(1, -(-m // size)) for m in masses], targets)
    plan = materialize(spark.createDataFrame(_rows(who, ids), "_id long, _nth long, _slots array<int>"))
    # checked: a name, a number and 4 bytes a slot for each of so many sources at most
    small = F.broadcast if len(ids) <= BROADCAST_SOURCES else lambda df: df

    named = sizes.select("_name", "_id", F.greatest(F.lit(1), F.ceil(F.col("mass") / size)).alias("_blocks"))
    rows = rows.join(small(named), F.col("in_source").eqNullSafe(F.col("_name"))).withColumn("_order", F.xxhash64("in_doc_id", "in_text"))
    stretches = max(1, sum(found["rows"].to_pylist()) // STRETCH_ROWS)
    placed = running_totals(rows, ["_id"], F.pmod("_order", F.lit(stretches)), ["_order", "in_doc_id"], {"_before": "_chars"})
    placed = placed.withColumn("_block", F.least(F.floor(F.col("_before") / size), F.col("_blocks") - 1))
    placed = placed.withColumn("_nth", F.floor(F.col("_block") / ROW_SLOTS)).join(small(plan), ["_id", "_nth"])
    return placed.select(
        *[F.col(f"in_{c}").alias(c) for c in kept],
        F.col("_chars").alias("chars"),
        F.col("_block").alias("block"),
        F.get("_slots", (F.col("_block") % ROW_SLOTS).cast("int")).cast("long").alias("slot"),
        (F.col("_before") - F.col("_block") * size).alias("offset"),
    )


def mixed_order(documents: DataFrame, weights: dict | None = None, block_chars: int | None = None) -> DataFrame:
    """`documents`, all rows and only its columns, sorted into the mixed order."""
    return mix(documents, weights, block_chars).orderBy("slot", "offset", "doc_id").select(*documents.columns)
