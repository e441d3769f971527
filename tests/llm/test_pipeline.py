"""The pipeline, stage by stage, against plain versions of what each stage decides."""

from collections import Counter

import pytest

import corpus_pipeline
from textloom.llm.common import materialize, table
from textloom.llm.language_id import held_out, predict, train

from .test_dedup import plain_lines
from .test_near_dedup import plain

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(stages):
    assert list(stages) == ["language", "lines", "near_duplicates", "mixing", "packing"]
    for before, after in list(stages.values())[:-1]:
        assert after.dtypes == before.dtypes


def test_language(stages):
    before, after = stages["language"]
    found = predict(before, train(before.filter(~held_out())), ["doc_id"]).collect()
    kept = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert rows(after) == rows(before.filter(before["doc_id"].isin(kept)))
    assert after.count() > 0.98 * before.count()


def test_lines(stages):
    before, after = stages["lines"]
    want = {r[0]: r[1] for r in plain_lines([(r["doc_id"], r["text"], None, r["source"]) for r in before.collect()], 5)}
    got = {r["doc_id"]: r for r in after.collect()}
    assert {i: r["text"] for i, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    keep = set(plain([(r["doc_id"], r["text"]) for r in before.collect()])[0].values())
    assert rows(after) == rows(before.filter(before["doc_id"].isin(keep)))


def test_mixing(stages):
    before, after = stages["mixing"]
    assert rows(after) == rows(before)


def test_packing(stages):
    before, after = stages["packing"]
    packed = Counter()
    for r in after.collect():
        packed[r["doc_id"]] += r["length"]
    assert packed == {r["doc_id"]: len(r["text"]) for r in before.collect()}


def test_run(spark, stages):
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages["packing"][1])


def test_odd_and_empty_documents(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF))
        docs.count()
