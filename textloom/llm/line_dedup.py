"""Cross-site line dedup by distinct-site spread.

A HyperLogLog sketch of sites is kept for each line hash and merged by
aggregation. Lines whose estimate is clearly over the threshold are
boilerplate; for those near it, whose estimate could be on the wrong side, the
distinct sites are counted exactly. The first copy of a boilerplate line, by
doc_id and position, stays; the others are cut from their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

MIN_SITES = 5
LG_K = 10
#: Relative distance from the threshold within which sites are counted exactly: ten standard errors at LG_K 10.
NEAR = 0.35
BLANKS = " \t\r"


def _key(line: Column) -> list[Column]:
    """128 bits of a line without its outer blanks, as two independent 64-bit hashes."""
    bare = F.btrim(line, F.lit(BLANKS))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")]


def lines_of(documents: DataFrame, site: str) -> DataFrame:
    """Rows doc_id, text_key, pos, h1, h2, site: all lines but blank ones. text_key tells rows of one doc_id apart."""
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_key"), F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.filter(F.btrim("line", F.lit(BLANKS)) != "").select("doc_id", "text_key", "pos", *_key(F.col("line")), "site")


def boilerplate(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES, near: float = NEAR) -> DataFrame:
    """Rows h1, h2, first_id, first_pos: the lines on `min_sites` sites or more, with the place of the first copy."""
    lines = lines_of(documents, site)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"),
        F.min(F.struct("doc_id", "pos")).alias("first"),
        F.count("*").alias("n"),
    )
    # a line on min_sites sites has as many copies at least
    spread = materialize(spread.filter((F.col("n") >= min_sites) & (F.col("sites") >= int(min_sites * (1 - near)))))
    unsure = spread.filter(F.col("sites") <= min_sites * (1 + near))
    exact = lines.join(unsure.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.count("*").alias("n"))
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("exact")).filter(F.col("exact") >= min_sites)
    sure = spread.filter(F.col("sites") > min_sites * (1 + near)).select("h1", "h2", "first")
    both = sure.unionByName(unsure.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))
    return both.select("h1", "h2", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("first_pos"))


def line_dedup(documents: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`documents` with boilerplate cut from `text`, and the columns n_lines and n_removed.

    A line is boilerplate if, without blanks at its ends, it occurs on `min_sites`
    distinct non-null sites or more. Its copy with the smallest (doc_id, position),
    null ids first, stays; rows that repeat both id and text keep it alike. Blank
    lines always stay. A null text stays null and has no lines; an empty text is
    one blank line; a text may become empty. Rows with a null doc_id or site are
    cut like the others. An empty table gives no rows. Columns of the input called
    n_lines or n_removed are replaced; other columns are passed on.
    """
    found = materialize(boilerplate(documents, site, min_sites))
    hits = lines_of(documents, site).join(found, ["h1", "h2"])
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))
    cuts = hits.filter(~first).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("cut"))

    kept_columns = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    d, c = documents.select(*kept_columns).alias("d"), cuts.alias("c")
    same = F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64("d.text") == F.col("c.text_key"))
    joined = d.join(c, same, "left").select("d.*", F.col("c.cut").alias("_cut"), F.split("d.text", "\n").alias("_lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_cut"))
    text = F.when(F.col("_cut").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n")
    )
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in kept_columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias("n_removed"),
    )
