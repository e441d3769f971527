"""The packed sequences follow the mixed order."""

from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm.common import materialize
from textloom.llm.packing import best_fit

SIZES = {"hot": 16000, "mid": 4000, "rare": 1000}


def test_stretches_meet_the_weights(spark):
    """Sizes 16:4:1 are tempered to weights 4:2:1; any stretch of bins meets them while no source has run out."""
    rows = [(i, "x" * (1500 + i % 1000), s) for i, s in enumerate(s for s, n in SIZES.items() for _ in range(n))]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    stages = dict(corpus_pipeline.STAGES)
    packed = stages["packing"](spark, materialize(stages["mixing"](spark, docs, "")), "").toPandas()
    source = {i: s for i, _, s in rows}
    packed["source"] = packed["doc_id"].map(source)
    chars = packed.pivot_table(index="bin_id", columns="source", values="length", aggfunc="sum", fill_value=0).sort_index()
    assert int(chars.values.sum()) == sum(len(t) for _, t, _ in rows)
    # rare, the first to run out, has 1/7 of the characters until then
    full = chars[chars.cumsum().sum(axis=1) < 0.9 * 7 * chars["rare"].sum()]
    width = len(full) // 3
    for at in range(0, len(full) - width, width // 4):
        stretch = full.iloc[at : at + width].sum()
        share = stretch / stretch.sum()
        assert abs(share["hot"] - 4 / 7) < 0.06 and abs(share["mid"] - 2 / 7) < 0.06 and abs(share["rare"] - 1 / 7) < 0.06
    unmixed = stages["packing"](spark, docs, "").toPandas()
    assert sorted(map(tuple, unmixed[["doc_id", "bin_id"]].values.tolist())) != sorted(map(tuple, packed[["doc_id", "bin_id"]].values.tolist()))


def test_bins_are_consecutive_and_whole(spark):
    docs = spark.createDataFrame([(i, "y" * (i * 37 % 50000)) for i in range(400)], "doc_id long, text string")
    rows = best_fit(docs, row=F.col("doc_id"), shard_pieces=50).collect()
    held = {}
    for r in rows:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == {i: i * 37 % 50000 for i in range(400)}
    first = {}
    for r in rows:
        if r["bin_id"] is not None:
            first.setdefault(r["bin_id"] >> 32, []).append(r["doc_id"])
    shards = [first[k] for k in sorted(first)]
    assert len(shards) > 5 and all(max(a) <= min(b) for a, b in zip(shards, shards[1:], strict=False))
