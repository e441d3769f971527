"""Approximate nearest neighbours by a hash-prefix forest (LSH forest).

Each tree gives every vector a long string of bits, one for the side of each of
KEY_BITS random hyperplanes, and keeps the strings as sorted arrays. A query goes
down each tree to the strings with the longest common prefix; then it ascends all
trees at once, one bit at a time, until its prefixes hold a certain share of the
strings. These candidates are compared by exact inner product.

The share is measured: a bounded sample of queries is compared with all vectors in
one pass, which also counts the strings under each of their prefixes and notes how
long a prefix they have in common with their true neighbours. The smallest share that
finds TARGET of these neighbours is taken. So it follows the data at every size: well
separated clusters need little, directions without any structure need much.

Inner product is turned into angle by a further component: the index gets
sqrt(M^2 - norm^2), queries get 0. As M has to be the largest norm, a few long vectors
would make all others look alike; so vectors are parted into bands by their norms, each
within a factor of two and with a forest of its own.

In Spark a tree is dealt over blocks: strings with the same first bits, split
further into parts of bounded size. A query visits the blocks of its own prefix;
where a prefix has very many queries, these too are dealt over copies of its parts.
First each block counts the strings under each prefix length, which fixes how far
the query ascends; then each block scores its candidates and passes on its best.
Queries whose blocks hold too few strings ascend past them: they are run again
with shorter block prefixes, in the end none.

Equal vectors are indexed once, with the smallest ids that have it, as no more of
them can be among the nearest; so copies cost nothing and cannot crowd a block.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import materialize

TREES = 16
KEY_BITS = 128
#: Queries whose true neighbours are found, to measure the share of strings to compare; and what it has to find of them.
SAMPLE = 64
TARGET = 0.95
#: Shares that are tried, each so many times the one before.
STEP = 1.1
#: Bands of norms: the last one has all the shorter vectors.
BANDS = 24
#: Strings of one part of a block, about.
PART = 8192
#: Queries that one copy of a part gets, about.
ASKING = 8192
#: Queries that are scored against a part at once.
SCORED_AT_ONCE = 256
#: Bits by which queries ascend past their blocks at once.
ASCENT = 3
SEED = 20240607


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class Forest:
    """The hash functions: `trees` strings for each vector of `dim` components, and the bands of norms up to `norm`."""

    def __init__(self, dim: int, norm: float, trees: int = TREES):
        self.dim, self.norm, self.trees = dim, norm, trees

    def bands(self, x: np.ndarray) -> np.ndarray:
        """Band b has the norms over norm / 2^(b + 1) and up to norm / 2^b."""
        # the largest component is taken out first, as squares of very short vectors would vanish
        top = np.abs(x).max(axis=1)
        size = top / self.norm * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))
        return np.clip(np.floor(-np.log2(np.minimum(size, 1))), 0, BANDS - 1).astype(np.int32)

    def keys(self, x: np.ndarray, bands: np.ndarray | None) -> np.ndarray:
        """uint8 array vectors x trees x KEY_BITS / 8. For queries `bands` is None."""
        planes = np.random.default_rng(SEED).standard_normal((self.dim + 1, self.trees * KEY_BITS))
        if bands is None:
            spare, scale = np.zeros(len(x)), np.abs(x).max(axis=1)
        else:
            scale = self.norm * 0.5**bands
            spare = np.sqrt(np.maximum(0, 1 - ((x / scale[:, None]) ** 2).sum(axis=1)))
        sides = np.hstack([x / scale[:, None], spare[:, None]]) @ planes > 0
        return np.packbits(sides.reshape(len(x), self.trees, KEY_BITS), axis=2)


def _filed(rows: DataFrame, forest: Forest) -> DataFrame:
    """For each row and tree: id, band, tree, key, vector. Rows with a column band are queries, filed there."""
    asking = "band" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"), forest.dim)
            bands = batch.column("band").to_numpy() if asking else forest.bands(x)
            keys = forest.keys(x, None if asking else bands)
            for t in range(forest.trees):
                columns = [batch.column("id"), pa.array(bands, pa.int32()), pa.array(np.full(len(x), t, np.int32)), pa.array([k.tobytes() for k in keys[:, t]], pa.binary()), batch.column("vector")]
                yield pa.RecordBatch.from_arrays(columns, ["id", "band", "tree", "key", "vector"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("id", "vector", *(["band"] if asking else [])).mapInArrow(run, f"id long, band int, tree int, key binary, vector {kind}")


def _prefix(depth: int) -> Column:
    """The first `depth` bits of the key as a number; depth is 32 at most."""
    first = F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long")
    return F.shiftright(first, 32 - depth)


class _Sorted:
    """The sorted array of one part of one tree."""

    def __init__(self, keys: pa.ChunkedArray):
        values = [int.from_bytes(k, "big") for k in keys.to_pylist()]
        self.order = sorted(range(len(values)), key=values.__getitem__)
        self.keys = [values[i] for i in self.order]

    def range(self, key: int, depth: int) -> tuple[int, int]:
        """Where the strings lie that share the first `depth` bits of `key`."""
        s = KEY_BITS - depth
        return bisect_left(self.keys, key >> s << s), bisect_left(self.keys, ((key >> s) + 1) << s)


def _counter(depth: int):
    """For a cogroup of queries and index: the counts from `depth` on. A closure, as Spark reads a function's arity."""
    return lambda queries, index: _count(depth, index, queries)


def _count(depth: int, index: pa.Table, queries: pa.Table) -> pa.Table:
    """query, band, counts: how many strings share the first depth, depth + 1, ... bits, down to the longest match."""
    array, found = _Sorted(index["key"]), []
    for key in queries["key"].to_pylist():
        value, counts = int.from_bytes(key, "big"), []
        for p in range(depth, KEY_BITS + 1):
            low, high = array.range(value, p)
            if low == high:
                break
            counts.append(high - low)
        found.append(counts)
    return pa.table({"query": queries["id"], "band": queries["band"], "counts": pa.array(found, pa.list_(pa.int64()))})


def _best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of q: its number, and the ids and exact inner products of its k nearest rows of x."""
    for at in range(0, len(q), SCORED_AT_ONCE):
        rough = q[at : at + SCORED_AT_ONCE] @ x.T
        slack = 1e-9 * np.maximum(1.0, np.abs(rough).max(axis=1))
        least = np.full(len(rough), -np.inf) if len(x) <= k else np.partition(rough, -k, axis=1)[:, -k] - slack
        for i, row in enumerate(rough):
            near = np.flatnonzero(row >= least[i])
            exact = (x[near] * q[at + i]).sum(axis=1)
            best = np.lexsort((ids[near], -exact))[:k]
            yield at + i, ids[near[best]], exact[best]


def _score(dim: int, k: int, index: pa.Table, queries: pa.Table) -> pa.Table:
    """query, id, score: of each query's candidates in this part the k best. Queries of the same prefix are scored together."""
    out: dict[str, list] = {"query": [], "id": [], "score": []}
    if index.num_rows and queries.num_rows:
        array = _Sorted(index["key"])
        x = _matrix(index["vector"], dim)[array.order]
        ids = index["id"].to_numpy()[array.order]
        q, names = _matrix(queries["vector"], dim), queries["id"].to_pylist()
        together = defaultdict(list)
        for i, (key, depth) in enumerate(zip(queries["key"].to_pylist(), queries["depth"].to_pylist(), strict=True)):
            together[array.range(int.from_bytes(key, "big"), depth)].append(i)
        for (low, high), asked in together.items():
            if low < high:
                for i, near, scores in _best(x[low:high], ids[low:high], q[asked], k):
                    out["query"] += [names[asked[i]]] * len(near)
                    out["id"] += near.tolist()
                    out["score"] += scores.tolist()
    return pa.table({"query": pa.array(out["query"], pa.int64()), "id": pa.array(out["id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def _common_bits(keys: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How many first bits each of `keys` (vectors x trees x bytes) has in common with `key` (trees x bytes)."""
    differing = np.bitwise_xor(keys, key[None])
    byte = (differing != 0).argmax(axis=2)
    value = np.take_along_axis(differing, byte[:, :, None], axis=2)[:, :, 0]
    return np.where(value == 0, KEY_BITS, byte * 8 + 7 - np.floor(np.log2(np.maximum(value, 1))).astype(np.int64))


def measured_share(index: DataFrame, queries: DataFrame, k: int, forest: Forest, sample: int = SAMPLE, target: float = TARGET) -> float:
    """The smallest share of the strings with which `sample` queries find `target` of their true k nearest.

    The sample is compared with all of `index` in one pass. What reaches the driver are the sample's vectors, and
    for each its k nearest and the counts of strings by common prefix length.
    """
    asked = queries.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    if not asked.num_rows:
        return 1.0
    q, names = _matrix(asked["vector"], forest.dim), asked["id"].to_pylist()
    own = forest.keys(q, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros((len(q), KEY_BITS + 1), np.int64))
        for batch in batches:
            x, ids = _matrix(batch.column("vector"), forest.dim), batch.column("id").to_numpy()
            bands = forest.bands(x)
            keys = forest.keys(x, bands)
            place = {i: n for n, i in enumerate(ids.tolist())}
            rows: list[tuple] = []
            for n, near, scores in _best(x, ids, q, k):
                bits = _common_bits(keys, own[n])
                for b in np.unique(bands):
                    counts[int(b)][n] += np.bincount(bits[bands == b].ravel(), minlength=KEY_BITS + 1)
                at = [place[i] for i in near.tolist()]
                rows += zip([n] * len(at), bands[at].tolist(), bits[at].max(axis=1).tolist(), near.tolist(), scores.tolist(), [0] * len(at), strict=True)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
        rows = [(n, b, d, None, None, int(c)) for b, table in counts.items() for n in range(len(q)) for d, c in enumerate(table[n]) if c]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([("query", pa.int32()), ("band", pa.int32()), ("bits", pa.int32()), ("id", pa.int64()), ("score", pa.float64()), ("n", pa.int64())])
    found = materialize(index.select("id", "vector").mapInArrow(run, "query int, band int, bits int, id long, score double, n long"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    true = found.filter("id is not null").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).collect()
    held: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(KEY_BITS + 1, np.int64))
    for r in found.filter("id is null").groupBy("query", "band", "bits").agg(F.sum("n").alias("n")).collect():
        held[r["query"], r["band"]][r["bits"]] = r["n"]
    # by number of bits: strings with that prefix or a longer one in common; at 0 all the band's strings
    held = {key: n[::-1].cumsum()[::-1] for key, n in held.items()}
    share = min(1.0, 1 / max(1, max(n[0] for n in held.values())))
    while share < 1:
        # the longest prefix under which there are strings enough
        depth = {key: np.flatnonzero(n >= np.ceil(share * n[0]))[-1] for key, n in held.items()}
        if sum(r["bits"] >= depth[r["query"], r["band"]] for r in true) >= target * len(true):
            break
        share = min(1.0, share * STEP)
    return share


def forest_search(index: DataFrame, queries: DataFrame, k: int, forest: Forest, share: float, part: int = PART, asking_at_once: int = ASKING) -> DataFrame:
    """Rows query, id, score: the k best found for each query. `index`, `queries`: id, vector; ids and vectors are distinct in each.

    A query compares the strings under the longest prefixes that hold `share` of a band's strings, all trees taken together.
    """
    filed = materialize(_filed(index, forest))
    # at most BANDS rows
    wanted_of = {r["band"]: max(1, int(np.ceil(r["n"] * share))) for r in filed.groupBy("band").agg(F.count("*").alias("n")).collect()}
    if not wanted_of:
        return queries.sparkSession.createDataFrame([], "query long, id long, score double")
    asking = materialize(_filed(queries.withColumn("band", F.explode(F.array(*map(F.lit, sorted(wanted_of))))), forest))
    candidates = F.element_at(F.create_map(*[F.lit(x) for pair in wanted_of.items() for x in pair]), F.col("band"))
    depth = max(0, min(32, int(np.log2(1 / (2 * share)))))
    found = None
    while True:
        tree = ["band", "tree", "prefix"]
        wanted = asking.withColumn("prefix", _prefix(depth))
        askers = wanted.groupBy(*tree).agg(F.ceil(F.count("*") / asking_at_once).alias("turns"))
        here = filed.withColumn("prefix", _prefix(depth))
        sizes = here.groupBy(*tree).agg(F.ceil(F.count("*") / part).alias("parts"))
        sizes = materialize(sizes.join(askers, tree))
        upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        dealt = here.join(sizes, tree).withColumns({"part": F.pmod(F.xxhash64("id"), F.col("parts")), "turn": upto("turns")})
        visits = wanted.join(sizes, tree).withColumns({"part": upto("parts"), "turn": F.pmod(F.xxhash64("id"), F.col("turns"))})
        block = [*tree, "part", "turn"]

        counted = visits.select(*block, "id", "key").groupBy(*block).cogroup(dealt.select(*block, "key").groupBy(*block))
        counts = counted.applyInArrow(_counter(depth), "query long, band int, counts array<long>")
        counts = counts.select("query", "band", F.posexplode("counts").alias("at", "n")).groupBy("query", "band", "at").agg(F.sum("n").alias("n"))
        enough = F.max(F.when(F.col("n") >= candidates, F.col("at") + depth))
        ascent = counts.groupBy("query", "band").agg(enough.alias("depth"))
        # short of strings, but at the root: it takes them all
        plan = materialize(ascent.filter(F.col("depth").isNotNull() | F.lit(depth == 0)).select(F.col("query").alias("id"), "band", F.coalesce("depth", F.lit(0)).alias("depth")))
        planned = visits.join(plan, ["id", "band"]).select(*block, "id", "key", "vector", "depth")
        scored = planned.groupBy(*block).cogroup(dealt.select(*block, "id", "key", "vector").groupBy(*block))
        scored = scored.applyInArrow(lambda q, i: _score(forest.dim, k, i, q), "query long, id long, score double")
        found = scored if found is None else found.unionByName(scored)
        if depth == 0:
            break
        asking = materialize(asking.join(plan.select("id", "band"), ["id", "band"], "left_anti"))
        if asking.isEmpty():
            break
        depth = max(0, depth - ASCENT)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank")


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, trees: int = TREES, share: float | None = None, part: int = PART) -> DataFrame:
    """Rows query_id, rank, vec_id, score: for each vec_id divisible by `every` the `k` nearest found, by inner product.

    A query is not its own neighbour; ties go to the smaller vec_id; a query with
    fewer candidates than k gets them all. Vectors that are null, zero or hold null
    or non-finite components take no part, nor do those of another length than the
    most frequent one and rows without vec_id. Of rows that repeat a vec_id the
    smallest vector counts. An empty table gives no rows; other columns are not read.
    `share`: the share of strings to compare; by default it is measured.
    """
    # floats are passed on as floats, half as large, and compared as doubles
    vector = F.col("embedding") if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), vector.alias("vector")).filter("id is not null and vector is not null")
    rows = rows.filter(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
    rows = materialize(rows)
    common = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 1
    rows = rows.filter(F.size("vector") == dim)
    top = F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    # the largest component is taken out first, as squares may be out of range
    length = F.col("top") * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.col("top")) * (x / F.col("top"))))
    norm = rows.withColumn("top", top).agg(F.max(length)).first()[0] or 1.0

    copies = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1)
    index = first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    index = materialize(index.select(F.element_at("ids", 1).alias("id"), "vector", "ids"))
    asked = rows.filter(F.col("id") % every == 0).withColumnRenamed("id", "query_id")
    asked = materialize(asked.join(index.select("id", "vector"), "vector").select("query_id", F.col("id").alias("query")))
    queries = index.join(asked.select(F.col("query").alias("id")).distinct(), "id", "left_semi")

    forest = Forest(dim, norm, trees)
    share = measured_share(index, queries, k + 1, forest) if share is None else share
    found = forest_search(index, queries, k + 1, forest, share, part)
    each = found.join(index.select("id", "ids"), "id").select("query", F.explode("ids").alias("vec_id"), "score")
    nearest_first = [F.desc("score"), F.col("vec_id")]
    each = each.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(*nearest_first))).filter(F.col("nth") <= k + 1)
    result = materialize(each).join(asked, "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest_first))
    return result.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
