"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints within `radius` bits of each other are found by masks instead of by
luck. Each of the 64 bit positions carries a non-zero vector of radius + 1 bits;
mask v, one for each non-zero vector, keeps the positions whose vector has odd
overlap with v. The vectors of up to `radius` positions leave some v with even
overlap to them all, so that two fingerprints that differ in those positions
agree under mask v: every pair within the radius meets in some table.

Only distinct fingerprints go into the tables, so copies cost nothing there. In
a table entry of few fingerprints all pairs are compared. In a larger one each
fingerprint is filed under itself and under every flip of up to radius / 2 of
the bits that its mask leaves out; two fingerprints of the entry share such a
file exactly if they are within the radius, so no pairs are formed and no
link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize
from textloom.llm.components import components, one_of_each

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
SEED = 42
#: Table entries of up to this many fingerprints are compared pair by pair.
SMALL_ENTRY = 32
#: Shingles whose hashes are held at once.
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS, at_once: int = SHINGLES_AT_ONCE) -> int:
    """The 64-bit fingerprint of one text, unsigned; 0 for a text without words.

    Words are runs of other characters than blanks and \\t\\n\\v\\f\\r, A-Z lower-cased.
    Shingles count as often as they occur; a text of fewer words is one shingle.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    width = min(words_per_shingle, len(words))
    begins = starts[: len(words) - width + 1]
    ends = starts[width - 1 :] + lengths[width - 1 :]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(begins), at_once):
        spans = zip(begins[at : at + at_once].tolist(), ends[at : at + at_once].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(begins)).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text")]
        signed = pa.array(np.array(values, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), signed], ["doc_id", "text_hash", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """Rows doc_id, text_hash, fp: a hash of the text, and the fingerprint as a signed long, for every row."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return docs.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks; position i carries the non-zero vector i mod (2^(radius+1) - 1) + 1."""
    n = (1 << (radius + 1)) - 1
    carried = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (carried[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(fp: Column, mask: int, radius: int) -> Column:
    """`fp` and every flip of up to radius / 2 of the bits outside `mask`."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    flips = [0, *(sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(free, k))]
    return F.transform(F.array(*[F.lit(_signed(x)) for x in flips]), lambda x: fp.bitwiseXOR(x))


def links(nodes: DataFrame, radius: int = RADIUS, small_entry: int = SMALL_ENTRY) -> DataFrame:
    """Rows a, b of nodes whose fingerprints are within `radius` bits; `nodes`: distinct fp, node.

    Not all pairs are listed, but all nodes within the radius are connected. The
    radius must be even for the files of large entries to be exact.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    all_masks = masks(radius)
    entry = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(all_masks)]))
    filed = nodes.select("fp", "node", entry.alias("e")).select("fp", "node", "e.t", "e.key")
    sizes = filed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(filed.join(sizes, ["t", "key"]))

    member = F.struct("node", "fp")
    groups = shared.filter(F.col("n") <= small_entry).groupBy("t", "key").agg(F.array_sort(F.collect_list(member)).alias("m"))
    pair = lambda x: F.transform(
        F.filter(F.col("m"), lambda y: (y["node"] > x["node"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= radius)),
        lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")),
    )
    near = groups.select(F.explode(F.flatten(F.transform("m", pair))).alias("p")).select("p.a", "p.b")

    large = shared.filter(F.col("n") > small_entry)
    file = F.lit(None).cast("array<bigint>")
    for t, m in enumerate(all_masks):
        file = F.when(F.col("t") == t, _flips(F.col("fp"), m, radius)).otherwise(file)
    files = large.select("node", "t", F.explode(file).alias("file")).groupBy("t", "file").agg(F.collect_set("node").alias("m"))
    # a file holds at most its own value and the flips of it, so this list is short
    files = files.filter(F.size("m") > 1).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).filter("a <> b")
    return near.unionByName(files).distinct()


def _grouped(documents: DataFrame, radius: int) -> DataFrame:
    """One row per input row: doc_id, text_hash, fp, the component's node, component_id."""
    each = materialize(fingerprints(documents))
    # a node is named by its smallest doc_id; ids may repeat over fingerprints, so the fingerprint completes the name
    node = F.struct(F.col("first").isNull().alias("no_id"), F.col("first").alias("id"), F.col("fp").alias("fp"))
    nodes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", node.alias("node")))
    found = components(links(nodes, radius)).select(F.col("node.fp").alias("linked_fp"), "component")
    named = nodes.join(found, F.col("fp") == F.col("linked_fp"), "left")
    named = materialize(named.select("fp", F.coalesce("component", "node").alias("component")))
    return each.join(named, "fp").select("doc_id", "text_hash", "fp", "component", F.col("component.id").alias("component_id"))


def simhash_components(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    The fingerprint is 16 lowercase hex digits. Rows whose fingerprints differ in
    `radius` bits or fewer are linked; component_id is the smallest doc_id that
    links reach, the row's own included. Texts that are null, empty or of blanks
    have fingerprint zero and are linked like any other. Rows with a null doc_id
    get the fingerprint and component of their links; if no linked row has an id
    the component is null. Repeated rows give repeated results. An empty table
    gives no rows; columns other than doc_id and text are not read.
    """
    return _grouped(documents, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """`documents` without near-duplicates: of each component one row stays, that with the smallest doc_id.

    A row with a null doc_id stays only if no row of its component has one. Of rows
    that have the same id, or repeat as a whole, one stays.
    """
    return one_of_each(documents, _grouped(documents, radius).select("doc_id", "text_hash", F.col("component").alias("group")))
