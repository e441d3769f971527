"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows node, component: for each node that a link names, the smallest node reachable.

    Each round every node, and the node it pointed to, take the smallest label
    among the node's neighbours; then pointers are shortened by one jump. Labels
    only ever shrink, so rounds go on until none changes. All grouping is by
    min(), which combines before the shuffle, so that a node with very many links
    is no burden to a task. Self-links and repeated links do no harm; links with
    a null end are ignored; no links give no rows.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(at.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").select(F.col("a").alias("node"), "near")
        best = near.groupBy("node").agg(F.min("near").alias("near")).join(at, "node")
        told = best.select("node", F.least("near", "label").alias("label")).unionByName(best.select(F.col("label").alias("node"), F.least("near", "label").alias("label")))
        told = told.groupBy("node").agg(F.min("label").alias("label"))
        up = told.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = told.join(up, "label", "left").select("node", F.least("label", "next").alias("label"))
        new = materialize(new)
        if at.join(new.withColumnRenamed("label", "new"), "node").filter("label <> new").isEmpty():
            return new.withColumnRenamed("label", "component")
        at = new


def one_of_each(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of `documents` for each group, that with the smallest doc_id; null ids come last.

    `rows` has doc_id, text_hash (xxhash64 of the text) and group for every row. Where
    rows agree in id and text, any one of them stays.
    """
    rows = materialize(rows)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    kept = rows.groupBy("group").agg(least.alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"))
    times = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_times"))
    kept = kept.join(times, F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_hash").eqNullSafe(F.col("text_hash"))).select("_id", "_hash", "_times")
    kept = materialize(kept)
    named = documents.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(documents.columns)])
    doc, text = (F.col(f"in_{documents.columns.index(c)}") for c in ("doc_id", "text"))
    same = doc.eqNullSafe(F.col("_id")) & F.xxhash64(text).eqNullSafe(F.col("_hash"))
    single = named.join(kept.filter("_times = 1"), same, "left_semi")
    several = named.join(kept.filter("_times > 1"), same).dropDuplicates(["_id", "_hash"]).select(*named.columns)
    return single.unionByName(several).toDF(*documents.columns)
