"""Exact dedup, line dedup and SimHash against plain versions."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash

from textloom.llm.components import components
from textloom.llm.exact_dedup import exact_dedup, identities
from textloom.llm.line_dedup import boilerplate, line_dedup
from textloom.llm.simhash import keep_one_per_component, links, masks, simhash_components

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [4, 37, 16384])
def test_exact(odd, odd_rows, block_bytes):
    got = sorted(map(tuple, exact_dedup(odd, block_bytes).collect()), key=repr)
    assert got == plain_exact([(i, t) for i, t, _, _ in odd_rows])


def test_exact_tells_clashing_blocks_apart(odd, odd_rows):
    got = defaultdict(set)
    for r in identities(odd, 64, hash_bits=1).collect():
        got[r["level"], r["name"]].add(r["text_sha256"])
    assert all(len(x) == 1 for x in got.values())
    assert len(got) == len({lower(t) for _, t, _, _ in odd_rows})


def test_empty_tables(empty):
    assert exact_dedup(empty).count() == 0
    assert line_dedup(empty).count() == 0
    assert simhash_components(empty).count() == 0
    assert keep_one_per_component(empty).count() == 0


def plain_lines(rows, min_sites):
    sites, first = defaultdict(set), {}
    order = lambda i: (i is not None, i or 0)
    for i, t, _, s in rows:
        for pos, line in enumerate(t.split("\n") if t is not None else []):
            bare = line.strip(" \t\r")
            if bare:
                sites[bare] |= {s} - {None}
                first[bare] = min(first.get(bare, ((True, 1e9), 0)), (order(i), pos))
    out = []
    for i, t, _, _ in rows:
        kept = None if t is None else [
            x for pos, x in enumerate(t.split("\n")) if not (b := x.strip(" \t\r")) or len(sites[b]) < min_sites or first[b] == (order(i), pos)
        ]
        out.append((i, None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_sites", [2, 5, 6, 8])
def test_lines(odd, odd_rows, min_sites):
    got = line_dedup(odd, min_sites=min_sites)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr) == plain_lines(odd_rows, min_sites)


def test_lines_same_with_and_without_sketch(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by_sketch = {tuple(r) for r in boilerplate(docs).collect()}
    assert by_sketch == {tuple(r) for r in boilerplate(docs, near=0.9).collect()}


def plain_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_simhash(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    pairs = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 2]
    comp = plain_components(pairs, distinct)
    least = defaultdict(lambda: None)
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[comp[p]] = min(i, least[comp[p]] if least[comp[p]] is not None else i)
    return sorted(((i, f"{p:016x}", least[comp[p]]) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def test_simhash_odd(odd, odd_rows):
    got = sorted(map(tuple, simhash_components(odd).collect()), key=repr)
    assert got == plain_simhash([(i, t) for i, t, _, _ in odd_rows])


def test_simhash_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plain_simhash(rows)
    assert sorted(map(tuple, simhash_components(docs).collect()), key=repr) == want
    kept = {r["doc_id"] for r in keep_one_per_component(docs).collect()}
    assert kept == {c for _, _, c in want}


def test_masks_cover_all_pairs_within_the_radius():
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks(2))


@pytest.mark.parametrize("small_entry", [1, 3, 1000])
def test_large_entries_lose_no_link(spark, small_entry):
    import random

    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(20)}
    for _ in range(400):
        x = rng.choice(sorted(values))
        for _ in range(rng.choice([1, 2, 3])):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    values = sorted(values)
    rows = [(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(values)]
    found = {(r["a"], r["b"]) for r in links(spark.createDataFrame(rows, "fp long, node long"), small_entry=small_entry).collect()}
    want = [(i, j) for i, a in enumerate(values) for j in range(i) if (a ^ values[j]).bit_count() <= 2]
    assert plain_components(found, range(len(values))) == plain_components(want, range(len(values)))
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in found)


def test_components_of_a_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(100, 200)] + [(1, i) for i in range(300, 400)] + [(5, 5), (None, 3), (400, 399)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 201)}, **{i: 1 for i in [1, *range(300, 401)]}, 5: 5}
