"""Records, packing and halving: goldens, a plain fold, and the two packers against each other."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.model import byte_budget
from textloom.operators.chunk import chunk_texts, had_input, halves, pack, records
from textloom.operators.order import numbered, running_totals
from textloom.sources.text import from_text

SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def both(spark, texts, delimiter, budget):
    """Chunks of the two packers, which must agree: (source, place, text, bytes, records)."""
    sources = from_text(spark, *texts)
    a = sorted(map(tuple, chunk_texts(sources, delimiter, budget).collect()))
    b = sorted(map(tuple, pack(records(sources.repartition(3), delimiter), delimiter, budget).collect()))
    assert a == b
    return a


def plain(texts, delimiter, budget):
    out = []
    for s, text in enumerate(texts):
        held, cur, done = [], 0, []
        for r in [x for x in (text or "").split(delimiter) if x]:
            n = len(r.encode())
            if held and cur + n > budget:
                done.append((held, cur))
                held, cur = [], 0
            held.append(r)
            cur += n
        done += [(held, cur)] if held else []
        kept = [(delimiter.join(h).strip(SPACE), n, len(h)) for h, n in done]
        out += [(s, i, *c) for i, c in enumerate(c for c in kept if c[0])]
    return out


@pytest.mark.parametrize(
    "text,delimiter,budget,chunks",
    [
        ("one\ntwo\nthree\nfour\nfive\n", "\n", 8, ["one\ntwo", "three", "four\nfive"]),
        ("one||two||three", "||", 7, ["one||two", "three"]),
        (" \n\t", "\n", 10, []),
        ("", "\n", 10, []),
        ("averylongrecord\nb", "\n", 4, ["averylongrecord", "b"]),
    ],
)
def test_goldens(spark, text, delimiter, budget, chunks):
    assert [c[2] for c in both(spark, [text], delimiter, budget)] == chunks


def test_no_input(spark):
    assert not had_input(chunk_texts(from_text(spark, " \n\t", ""), "\n", 10))
    assert had_input(chunk_texts(from_text(spark, " \n\t", "x"), "\n", 10))


def test_chunks_never_cross_sources(spark):
    assert [c[:3] for c in both(spark, ["one\ntwo", "three\nfour"], "\n", 100)] == [(0, 0, "one\ntwo"), (1, 0, "three\nfour")]


@pytest.mark.parametrize("delimiter", ["\n", "||", "\0"])
def test_random_texts(spark, delimiter):
    rng = random.Random(8)
    texts = [delimiter.join(rng.choices(["", "a", "bb", "é", "   ", "dddd", "x" * 30, "\t", "😀😀"], k=rng.randrange(0, 60))) for _ in range(40)] + [None]
    for budget in (1, 7, 40):
        assert both(spark, texts, delimiter, budget) == plain(texts, delimiter, budget)


def test_record_limit(spark):
    with pytest.raises(Exception, match="record too long"):
        records(from_text(spark, "abc\nabcdef"), "\n", max_bytes=5).collect()


def test_budget():
    assert byte_budget(8192, 2048) == 16632 and byte_budget(2649, 2048) == 3
    with pytest.raises(ValueError):
        byte_budget(2648, 2048)


@pytest.mark.parametrize("text,delimiter,want", [("one||two||three||four", "||", ("one||two", "three||four")), ("abcdef", "||", ("abc", "def")), ("a\nb\nc", "\n", ("a", "b\nc")), ("é", "\n", None), ("é😀x", "\n", ("é", "😀x")), ("", "\n", None), ("\n", "\n", ("", ""))])
def test_halves(spark, text, delimiter, want):
    r = spark.createDataFrame([(text,)], "t string").select(halves(F.col("t"), delimiter).alias("h")).first()["h"]
    assert (None if r is None else tuple(r)) == want


def test_numbering_and_running_totals(spark):
    rows = [(i * 7919 % 1000, i % 3) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, k long").repartition(7)
    assert sorted(map(tuple, numbered(df, ["a"], "n").select("a", "n").collect())) == [(i, i + 1) for i in range(1000)]
    assert numbered(df.limit(0), ["a"], "n").count() == 0
    got = running_totals(df, ["k"], F.floor(F.col("a") / 10), ["a"], {"before": "a"})
    for r in got.collect():
        assert r["before"] == sum(a for a, k in rows if k == r["k"] and a < r["a"])


def test_many_chunks_of_one_source(spark):
    """Stretches of records end inside chunks and at their ends; time in proportion to the records."""
    import time

    rng = random.Random(9)
    texts = ["\n".join("x" * rng.randrange(1, 9) for _ in range(n)) for n in (255, 256, 257, 512, 1300)]
    for budget in (1, 7, 40, 3000):
        assert both(spark, texts, "\n", budget) == plain(texts, "\n", budget)
    began = time.perf_counter()
    assert chunk_texts(from_text(spark, "\n".join(["abc"] * 80_000)), "\n", 5).count() == 80_000
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("budget", [1, 7, 40, 300])
def test_one_source_in_many_parts(spark, monkeypatch, budget):
    """Parts and stretches far shorter than the source; records that reach over whole parts; gaps; a null key."""
    rng = random.Random(budget)
    monkeypatch.setattr("textloom.operators.chunk.PART", 2)
    monkeypatch.setattr("textloom.operators.chunk.LEAST", 1)
    monkeypatch.setattr("textloom.operators.chunk.TEXTS", 16)
    rows, want = [], []
    for key, n in ((0, 3000), (None, 700), (2, 1), (3, 33)):
        pos, held, cur, chunks = 0, [], 0, []
        for _ in range(n):
            pos += rng.choice((1, 1, 1, 2, 40))
            record = rng.choice("ab ") * (rng.randrange(1, 12) if rng.random() < 0.98 else 9 * budget + 1)
            rows.append((key, pos, record, len(record)))
            if held and cur + len(record) > budget:
                chunks.append((held, cur))
                held, cur = [], 0
            held, cur = [*held, record], cur + len(record)
        chunks.append((held, cur))
        kept = [(t, c, len(h)) for h, c in chunks if (t := "\n".join(h).strip())]
        want += [(key, i, *c) for i, c in enumerate(kept)]
    recs = spark.createDataFrame(rows, "source_index long, record_pos int, record string, n_bytes int").repartition(5)
    got = [tuple(r) for r in pack(recs, "\n", budget).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pack_of_nothing(spark):
    recs = spark.createDataFrame([], "source_index long, record_pos int, record string, n_bytes int")
    assert pack(recs, "\n", 9).count() == 0
