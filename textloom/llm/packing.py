"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces of that length
and a rest. Pieces are dealt over shards of bounded size. In each shard they are
packed longest first: a piece goes to the open bin that it leaves with the least
room; if none has room, a bin is opened. Which length to open is weighed anew
for each bin, all permitted lengths together: for each one, what of the pieces
still to come would fill it best; the bin is opened at the length that costs least
for what it would then hold. In the end every bin is downsized to the cheapest
length that holds its contents. Opening one length wherever it fits is tried beside
that, for each length, and the cheapest of these packings is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, running_totals

CAPACITIES = (4096, 8192, 16384)
#: What a sequence costs besides its length, in the same unit.
PER_SEQUENCE = 64
#: Pieces of one shard, about. More would only save the less than full bins at each shard's end.
SHARD_PIECES = 20_000
#: The same where the order of documents is kept: within a shard it holds only roughly.
ORDERED_SHARD_PIECES = 2_000
#: Documents that one window task of the running sums gets, about.
STRETCH_ROWS = 1024


def default_costs(capacities: Sequence[int]) -> list[int]:
    return [c + PER_SEQUENCE for c in capacities]


class _Sizes:
    """The permitted lengths, and what to open or to keep."""

    def __init__(self, capacities: Sequence[int], costs: Sequence[float]):
        self.capacities, self.costs = list(capacities), list(costs)
        self.cheapest = sorted(range(len(capacities)), key=lambda i: (costs[i], capacities[i]))

    def downsized(self, used: int) -> int:
        return next(i for i in self.cheapest if self.capacities[i] >= used)

    def fixed(self, preferred: int, n: int) -> int:
        return preferred if preferred >= n else min(c for c in self.capacities if c >= n)

    def least_cost(self, falling: list[int], at: int) -> int:
        """What to open for the longest piece left: the length with the least cost for each unit that it would hold.

        `falling` are the negated lengths, so in rising order; those after `at` are still to come. A bin would be
        filled with the longest piece that fits, again and again.
        """
        best = None
        for capacity in self.capacities:
            room = capacity + falling[at]
            if room < 0:
                continue
            i = at + 1
            while room:
                i = bisect_left(falling, -room, i)
                if i == len(falling):
                    break
                room += falling[i]
                i += 1
            price = self.costs[self.downsized(capacity - room)] / (capacity - room)
            if best is None or price < best[0]:
                best = price, capacity
        return best[1]


def _best_fit(lengths: Sequence[int], sizes: _Sizes, opened: Callable[[int], int]) -> tuple[float, list[int], list[int]]:
    """The cost, the bin of each length, and each bin's capacity; `opened`: what to open for the piece at a place."""
    bins: list[int] = []
    used: list[int] = []
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    for i, n in enumerate(lengths):
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = opened(i), len(used)
            used.append(0)
        bins.append(b)
        used[b] += n
        if room > n:
            insort(open_bins, (room - n, b))
    kept = [sizes.downsized(u) for u in used]
    return sum(sizes.costs[i] for i in kept), bins, [sizes.capacities[i] for i in kept]


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, costs: Sequence[float] | None = None) -> tuple[list[int], list[int]]:
    """The bin of each length, and each bin's capacity. `lengths` are positive, longest first, none over the largest capacity."""
    sizes = _Sizes(sorted(capacities), [c for _, c in sorted(zip(capacities, costs or default_costs(capacities), strict=True))])
    falling = [-n for n in lengths]
    found = [_best_fit(lengths, sizes, lambda i: sizes.least_cost(falling, i))]
    found += [_best_fit(lengths, sizes, lambda i, c=c: sizes.fixed(c, lengths[i])) for c in sizes.capacities]
    return min(found, key=lambda f: f[0])[1:]


def _in_order(bins: list[int], sizes: list[int], lengths: list[int], positions: list[int]) -> tuple[list[int], list[int]]:
    """The same bins, numbered by the mean position of what they hold."""
    mass, total = [0] * len(sizes), [0] * len(sizes)
    for b, n, p in zip(bins, lengths, positions, strict=True):
        mass[b] += n
        total[b] += n * p
    order = sorted(range(len(sizes)), key=lambda b: (total[b] / mass[b], b))
    number = {b: i for i, b in enumerate(order)}
    return [number[b] for b in bins], [sizes[b] for b in order]


def _pack_shard(capacities: Sequence[int], costs: Sequence[float] | None, shard: pa.Table) -> pa.Table:
    shard = shard.sort_by([("length", "descending"), ("_id", "ascending"), ("start", "ascending")])
    bins, sizes = pack(shard["length"].to_pylist(), capacities, costs)
    if "position" in shard.column_names:
        bins, sizes = _in_order(bins, sizes, shard["length"].to_pylist(), shard["position"].to_pylist())
    offsets, filled = [], [0] * len(sizes)
    for b, n in zip(bins, shard["length"].to_pylist(), strict=True):
        offsets.append(filled[b])
        filled[b] += n
    first = shard["shard"][0].as_py() << 32
    columns = {
        "bin_id": [first + b for b in bins], "capacity": [sizes[b] for b in bins], "used": [filled[b] for b in bins], "offset": offsets,
    }
    return pa.table({"_id": shard["_id"], "start": shard["start"], "length": shard["length"], **{k: pa.array(v, pa.int64()) for k, v in columns.items()}})


def best_fit(documents: DataFrame, length: Column | None = None, capacities: Sequence[int] = CAPACITIES, costs: Sequence[float] | None = None, row: Column | None = None, shard_pieces: int | None = None) -> DataFrame:
    """Rows doc_id, start, length, bin_id, capacity, used, offset: where each piece of each document goes.

    `length` is a document's length, by default its code points. Piece
    [start, start + length) of the document fills [offset, offset + length) of bin
    bin_id, whose length is `capacity` and of which `used` are filled. No document
    is dropped or cut short: one without length gets a row of length 0 without a
    bin. Null texts and lengths count as 0. Rows that repeat are packed each; null
    doc_ids are kept. An empty table gives no rows; other columns are not read.

    With `row`, a distinct number for each document, bins follow that order: shards
    are stretches of consecutive pieces, and bins are numbered by where their
    pieces come from. Without it pieces are dealt at random.
    """
    capacities = sorted(capacities)
    longest = capacities[-1]
    n = F.coalesce(F.char_length("text") if length is None else length, F.lit(0)).cast("long")
    docs = documents.select(F.col("doc_id").alias("_id"), n.alias("_n"), (F.xxhash64("doc_id", "text") if row is None else row.cast("long")).alias("_deal"))
    docs = materialize(docs)  # texts are measured once
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("_n") - 1) / longest))), lambda i: i * longest)
    if row is None:
        docs = docs.withColumn("_before", F.lit(0).cast("long"))
    else:
        counted = docs.withColumns({"_one": F.lit(0), "_pieces": F.ceil(F.col("_n") / longest)})
        docs = running_totals(counted, ["_one"], F.floor(F.col("_deal") / STRETCH_ROWS), ["_deal"], {"_before": "_pieces"})
    pieces = docs.select("_id", "_n", "_deal", "_before", F.explode(starts).alias("start"))
    pieces = pieces.select("_id", "_deal", "_before", "start", F.least(F.col("_n") - F.col("start"), F.lit(longest)).alias("length"))

    filled = pieces.filter("length > 0")
    if row is None:
        shards = max(1, pieces.count() // (shard_pieces or SHARD_PIECES))
        # by text too, as ids may be null
        dealt = filled.select("_id", "start", "length", F.pmod(F.xxhash64("_deal", "start"), F.lit(shards)).alias("shard"))
    else:
        position = F.col("_before") + F.floor(F.col("start") / longest)
        dealt = filled.select("_id", "start", "length", position.alias("position"), F.floor(position / (shard_pieces or ORDERED_SHARD_PIECES)).alias("shard"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"_id {kind}, start long, length long, bin_id long, capacity long, used long, offset long"
    packed = dealt.groupBy("shard").applyInArrow(lambda t: _pack_shard(capacities, costs, t), schema)
    nothing = F.lit(None).cast("long")
    rest = pieces.filter("length = 0").select("_id", "start", "length", *[nothing.alias(c) for c in ("bin_id", "capacity", "used", "offset")])
    return packed.unionByName(rest).withColumnRenamed("_id", "doc_id")
