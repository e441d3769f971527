"""How filters interact: every order of them replayed over all documents.

Each document has one flag a filter. Its flags are crossed with the 120 orders of
the filters, a broadcast table of 120 rows; each order is exploded into its five
steps, and the first step whose filter the document fails is where it goes. Counts
are conditional sums by part, order and step, combined before the shuffle, so that
no more than 600 rows of a part leave a task.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import UPPER, materialize

FILTERS = "ABCDE"
#: A row in each of them for every part, order and step.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a non-null text fails each filter that looks at the text alone, by letter."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < F.size(words) * F.lit(50).cast("long"),
        "C": capitals * F.lit(100).cast("long") > F.char_length(text) * F.lit(2).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows part, A to E, good, toxic: what each document fails, and what it is labelled.

    E is true if a smaller doc_id has the very same text, told by SHA-256: if it isn't
    the smallest of its text. Those are found by min(), combined before the shuffle, and
    joined by id and text, so that no task gets all copies of a text. A null doc_id is
    neither smaller nor larger than another, and rows of one doc_id don't repeat each other. A document is good or toxic if any of its labels says so; without one it is neither.
    """
    text = F.coalesce("text", F.lit(""))
    flags = [c.alias(f) for f, c in text_flags(F.col("_text")).items()]
    docs = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("_text"))
    # read again below; a text is looked at once
    docs = materialize(docs.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), *flags))
    first = docs.groupBy(F.col("digest").alias("of")).agg(F.min("doc_id").alias("first"))
    of = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("labelled"))
    of = of.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    docs = docs.join(first, (F.col("doc_id") == F.col("first")) & (F.col("digest") == F.col("of")), "left").join(of, F.col("doc_id") == F.col("labelled"), "left")
    said = [(F.coalesce(c, F.lit(0)) == 1).alias(c) for c in ("good", "toxic")]
    return docs.select("part", *FILTERS[:4], (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"), *said)


def replay(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows part, filter_order, step, COUNTS and shapley for rows part, one boolean for each filter, good, toxic.

    Of 600 rows for each part and five filters none is left out. kept: documents that
    pass this step and all before; removed: those that fail here first; redundant:
    those that fail here but went before; unique_fails: those that fail this filter and
    no other; good_lost, toxic_lost: of the removed; shapley: what this step's filter
    removes, over all orders. No documents, no rows.
    """
    spark = flags.sparkSession
    orders = spark.createDataFrame([("".join(p),) for p in permutations(filters)], "filter_order string")
    # where each filter stands in the order, and which filter each step has
    at = {f: F.locate(f, F.col("filter_order")) for f in filters}
    fails_first = F.least(*[F.when(F.col(f), at[f]) for f in filters])
    never = F.lit(len(filters) + 1)
    n_failed = sum((F.col(f).cast("int") for f in filters), F.lit(0))
    own = F.when(F.lit(False), F.lit(False))
    for f in filters:
        own = own.when(F.substring("filter_order", F.col("step"), F.lit(1)) == f, F.col(f))

    crossed = flags.withColumn("n_failed", n_failed).crossJoin(F.broadcast(orders))
    first = F.coalesce(fails_first, never).alias("first")
    steps = crossed.select("part", "filter_order", "n_failed", "good", "toxic", *filters, first, F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    here = F.col("first") == F.col("step")
    counted = steps.withColumn("own", own).groupBy("part", "filter_order", "step").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"), F.count_if(here).alias("removed"), F.count_if(F.col("own") & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("own") & (F.col("n_failed") == 1)).alias("unique_fails"), F.count_if(here & F.col("good")).alias("good_lost"), F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    # all 120 rows of a part's filter, whatever the number of documents
    over = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counted.withColumn("shapley", F.sum("removed").over(over)).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """replay() of the five filters over whole `documents` (doc_id, text, source) with `labels` (doc_id, quality, toxic).

    A null text counts as empty, a null source as the part of the empty name.
    """
    return replay(flagged(documents, labels))
