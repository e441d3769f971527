"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes. Equal blocks get the
same integer name, different blocks different ones; then adjacent names of a
text are paired and each distinct pair gets a name, until every text is down to
one. Texts of one level with one name are equal, byte for byte: no step relies
on a hash being free of collisions.

Level 0 sorts the distinct blocks by (hash, block); the hash only spares the
later joins from carrying block texts. Where two different blocks share a hash
both are told apart by their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import lower_ascii, materialize

BLOCK_BYTES = 16384


def _named(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names that follow the sort order of the distinct rows; written, so that they are fixed."""
    ordered = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()))


def _first_names(docs: DataFrame, block_bytes: int, hash_bits: int) -> DataFrame:
    """Rows doc_id, text_sha256, pos, n, name: the names of every text's blocks."""
    binary = F.col("_text").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("_bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    # hashed here, once a text and not once a block
    texts = docs.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), binary.alias("_bytes"), n.alias("n"))
    # most texts are one block, which needs no slicing
    pieces = F.when(F.col("n") == 1, F.array("_bytes")).otherwise(cut)
    hashed = F.xxhash64("block") if hash_bits == 64 else F.pmod(F.xxhash64("block"), F.lit(1 << hash_bits))
    blocks = texts.select("doc_id", "text_sha256", "n", F.posexplode(pieces).alias("pos", "block"))

    distinct = blocks.select(hashed.alias("h"), "block").groupBy("h").agg(F.array_sort(F.collect_set("block")).alias("same"))
    distinct = distinct.select("h", F.size("same").alias("n_same"), F.posexplode("same").alias("ordinal", "block"))
    distinct = distinct.select("h", "ordinal", F.when(F.col("n_same") > 1, F.col("block")).alias("clash"))
    names = _named(distinct, ["h", "ordinal"])

    rows = blocks.select("doc_id", "text_sha256", "pos", "n", hashed.alias("h"), "block")
    if names.filter("clash is not null").isEmpty():
        return rows.drop("block").join(names.select("h", "name"), "h").drop("h")
    right = names.withColumnRenamed("h", "h_named")
    same = (rows["h"] == right["h_named"]) & (right["clash"].isNull() | (right["clash"] == rows["block"]))
    return rows.join(right, same).select("doc_id", "text_sha256", "pos", "n", "name")


def identities(documents: DataFrame, block_bytes: int = BLOCK_BYTES, hash_bits: int = 64) -> DataFrame:
    """One row for each distinct (doc_id, text): doc_id, text_sha256, copies, level, name.

    (level, name) is the same for two rows exactly if their normalised texts are
    equal. `copies` counts the input rows with that doc_id and text. `hash_bits`
    exists for tests, which force collisions with it.
    """
    docs = documents.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("_text"))
    at = materialize(_first_names(docs, block_bytes, hash_bits).withColumn("copies", F.lit(1).cast("long")))
    found, level = None, 0
    while True:
        done = at.filter("n = 1").groupBy("doc_id", "text_sha256", "name").agg(F.sum("copies").alias("copies"))
        done = done.select("doc_id", "text_sha256", "copies", F.lit(level).alias("level"), "name")
        found = done if found is None else found.unionByName(done)
        left = at.filter("n > 1")
        if left.isEmpty():
            return found
        even = F.col("pos") % 2 == 0
        pairs = left.groupBy("doc_id", "text_sha256", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("n") / 2).cast("int").alias("n")).agg(
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
            F.sum(F.when(even, F.col("copies")).otherwise(0)).alias("copies"),
        )
        pairs = materialize(pairs)
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"])
        at = materialize(pairs.join(names, ["a", "b"]).select("doc_id", "text_sha256", "pos", "n", "name", "copies"))
        level += 1


def exact_dedup(documents: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; a null text
    counts as empty. Of equal texts the row with the largest doc_id stays. Rows
    that repeat both id and text can't be told apart and are marked alike; a null
    doc_id stays only if its whole group has none. An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    ids = identities(documents, block_bytes)
    groups = ids.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    each = ids.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return each.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
