"""Very long runs of one kind: whole results in linear time."""

import re
import time

import pytest

from textloom.llm.secret_scan import RULES, digest, scan
from textloom.llm.token_counts import LONG_BLANKS, PATTERN, VOCABULARY, _count, _encoder, token_counts


@pytest.fixture(scope="module")
def ranks():
    with open(VOCABULARY, "rb") as file:
        return file.read()


@pytest.mark.parametrize("blank", [" ", "\n", " \n", " ", "\t ", "\x1c "])
@pytest.mark.parametrize("around", ["{}", "a{}", "{}b", "a {} b{}.", "x{}\x1f{}y", "{}7"])
def test_cut_runs_count_as_whole(ranks, blank, around):
    for n in (LONG_BLANKS - 1, LONG_BLANKS, LONG_BLANKS + 1):
        text = around.replace("{}", (blank * n)[:n])
        assert _count(ranks, PATTERN, text) == len(_encoder(ranks, PATTERN).encode_ordinary(text))


def test_runs_of_millions(spark):
    rows = [(i, c * 10_000_000 + t) for i, (c, t) in enumerate([(" ", ""), (" ", "x"), ("\n", "\n"), ("a", ""), ("7", " ")])]
    found = dict(token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    # single blanks of this vocabulary don't merge
    assert found[0] == 10_000_000 and found[1] == 10_000_000
    assert all(found[i] > 100_000 for i in (2, 3, 4))


WEB = next(r for r in RULES if r.kind == "web_token")


def test_web_tokens_as_the_plain_rule_finds_them(spark):
    part = "eyJ" + "a" * 8
    texts = [
        f"{part}.{part}.{'b' * 8}", f"--{part}.{part}.{'b' * 8}.{part}", f"{part}.{part}.{part}.{part}.{part}.{part}", f"xx{part}eyJeyJ.{part}.{part}",
        f"eyJ.{part}.{part}.{part}", f"eyJshort.{part}.{part}", f"aeyJ1234567eyJ.{part}.12345678", f"{part}.x{part}.{part}", f"{part}.{part}.1234567", f"é{part}.{part}.{part}é {part}.{part}.{part}",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "web_token"] for r in scan(df).collect()}
    assert found == {i: [m.span() for m in re.finditer(WEB.pattern, t)] for i, t in enumerate(texts)}


@pytest.mark.parametrize("start", ["eyJ", "eyJaaaaaaaaa.", "AKIA", "ghp_", "xoxb-", "AIza", "sk_live_", "a://", "a:b", "-----BEGIN ", "secret ", "token=", "abcdef"])
def test_a_megabyte_of_a_rules_own_beginning(spark, start):
    every = " .eyJx eyJaaaaaaaaa.eyJbbbbbbbb AKIA ghp_ xoxb- AIza sk_live_ :// PRIVATE KEY@ secret"
    df = spark.createDataFrame([(1, start * (1_000_000 // len(start)) + every)], "doc_id long, text string")
    began = time.monotonic()
    assert digest(scan(df)).count() == 1 and len(digest(scan(df)).collect()) == 1
    assert time.monotonic() - began < 60
