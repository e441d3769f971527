"""Phrases from positional lists against plain counting of every phrase."""

import random
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm.collocations import _packed, _steps, _sums, _unpacked, collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, min_count, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang, piece = lang or "und", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for x in ".,;:!?\n\v\f\r":
            piece = piece.replace(x, "\n")
        for p in piece.split("\n"):
            words = tuple(w for w in p.replace("\t", " ").split(" ") if w)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        gone = {q for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 100 * candidates[q := p[i : i + m]]}
        found = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, l, r = min((floor(Fraction(1000 * a * n[lang], counts[p[:k]] * counts[p[k:]])), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[x] for x in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def given():
    rng = random.Random(3)
    words = ["a", "A", "bb", "cc", "É", "😀x", "d e", "it's", "f-g", "\x01", "zz"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ; ", "?!"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    rows += [("en", "san  Francisco bay\tarea now")] * 40 + [("fr", "a " * 3000), (None, None), ("de", ""), ("de", " .,\n"), ("xx", "one word only")]
    return rows


@pytest.mark.parametrize("min_count", [1, 7, 40])
def test_equals_plain_counting(spark, given, min_count):
    df = spark.createDataFrame([(lang, text, 1, 2, 3, 4) for lang, text in given], "lang string, text string, id int, a int, block int, n int").repartition(5)
    assert rows_of(collocations(df, min_count=min_count)) == plain(given, min_count)


@pytest.mark.parametrize("size", [1, 500])
def test_blocks_of_any_size_give_the_same(spark, given, size):
    df = spark.createDataFrame(given, "lang string, text string").coalesce(2)
    assert rows_of(collocations(df, min_count=5, top=3, block=size)) == plain(given, 5, top=3)


def test_shorter_phrases_and_no_documents(spark, given, empty):
    df = spark.createDataFrame(given, "lang string, text string")
    assert rows_of(collocations(df, longest=3, min_count=9)) == plain(given, 9, longest=3)
    assert collocations(empty).count() == 0
    with pytest.raises(ValueError, match="2 to 5"):
        collocations(empty, longest=9)


def test_odd_rows(spark, odd, odd_rows):
    assert rows_of(collocations(odd, min_count=2)) == plain([(lang, t) for _, t, lang, _ in odd_rows], 2)


def test_numbers_in_few_bytes():
    """Packed and unpacked again: empty rows, none at all, the largest numbers, a slice of the rows."""
    values, ends = np.array([0, 5, 5, 127, 128, 1 << 31, (1 << 62) + 3]), np.array([0, 3, 3, 7, 7])
    packed = _packed(_steps(values, ends), ends)
    found, to = _unpacked(pa.chunked_array([packed]))
    assert _sums(found, to).tolist() == values.tolist() and to.tolist() == ends.tolist()
    found, to = _unpacked(pa.chunked_array([packed.slice(2)]))
    assert _sums(found, to).tolist() == values[3:].tolist() and to.tolist() == [0, 4, 4]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in _unpacked(pa.chunked_array([_packed(none, none)]))] == [0, 0]


def test_shuffles_no_row_for_each_phrase_of_a_block(spark):
    """Many pairs that are frequent, but rare in a block: what is shuffled is less than the text."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(200)]
    rows = [("en", " ".join(rng.choice(words) for _ in range(200))) for _ in range(600)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    before = sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))
    assert rows_of(collocations(df, min_count=2, longest=3, top=5, block=100_000)) == plain(rows, 2, longest=3, top=5)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    shuffled = sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size())) - before
    assert shuffled < 1.5 * sum(len(t) for _, t in rows)
