"""Near-duplicates of the pipeline against all pairs of texts, compared by their shingle sets."""

import random

import pytest
import xxhash

import corpus_pipeline
from textloom.llm import near_dedup
from textloom.llm.near_dedup import keep_one_per_group, near_duplicates
from textloom.llm.simhash import keep_one_per_component, masks


def plain_sets(rows):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return sets


def plain(rows, linked=None):
    """doc_id -> component_id, by comparing all pairs; also, how many pairs are similar."""
    sets, up, pairs = plain_sets(rows), list(range(len(rows))), 0

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                pairs += 1
                if linked is None or linked(i, j):
                    up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return {doc: least[root(i)] for i, (doc, _) in enumerate(rows)}, pairs


def plain_fingerprint(shingles):
    """Bit by bit, from the same hashes."""
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    out = []
    for part in range(near_dedup.PARTS):
        mixed = []
        for h in hashes:
            h = (h + 0x9E3779B97F4A7C15 * (part + 1)) % 2**64
            h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
            mixed.append(h ^ (h >> 31))
        out.append(sum(1 << i for i in range(near_dedup.PART_BITS) if 2 * sum(h >> i & 1 for h in mixed) > len(mixed)))
    return out


def check_groups(rows, got):
    """Nothing is joined that isn't similar; all is joined that the covering masks guarantee; little else is missed."""
    prints = [plain_fingerprint(s) for s in plain_sets(rows)]
    near = lambda i, j: min((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= near_dedup.RADIUS
    most, pairs = plain(rows)
    least, _ = plain(rows, near)
    groups = lambda of: {frozenset(d for d in of if of[d] == c) for c in set(of.values())}
    for g in groups(least):
        assert any(g <= h for h in groups(got))
    for g in groups(got):
        assert any(g <= h for h in groups(most)) and all(got[d] == min(g) for d in g)
    missed = sum(got[d] != most[d] for d in got)
    assert missed <= 0.03 * len(rows), (missed, pairs)


def texts(rng, families, copies):
    """Texts and near copies of them: some words replaced, so that similarities lie around 0.8."""
    rows = []
    for _ in range(families):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(copies):
            changed = list(words)
            for _ in range(rng.randrange(5)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(changed)))
    rng.shuffle(rows)
    return rows


def ids(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def test_all_pairs(spark):
    rows = [*texts(random.Random(5), 60, 5), (900, "a b"), (901, "A  b"), (902, None), (903, " "), (904, "a b c")]
    check_groups(rows, ids(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))))


def test_large_group(spark):
    rows = texts(random.Random(6), 2, 300)
    check_groups(rows, ids(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))))


def test_fingerprints():
    rng = random.Random(3)
    for n in (0, 1, 2, 40, 300):
        text = " ".join(f"w{rng.randrange(50)}" for _ in range(n))
        assert near_dedup.fingerprint(near_dedup.shingles(text)) == plain_fingerprint(plain_sets([(0, text)])[0])


def test_masks_cover():
    """Any RADIUS positions of a part are left out together by some mask."""
    rng = random.Random(4)
    found = masks(near_dedup.RADIUS, near_dedup.PART_BITS)
    assert len(found) == 2 ** (near_dedup.RADIUS + 1) - 1
    for _ in range(2000):
        differing = sum(1 << i for i in rng.sample(range(near_dedup.PART_BITS), near_dedup.RADIUS))
        assert any(not m & differing for m in found)


@pytest.mark.parametrize("keep", [keep_one_per_group, keep_one_per_component])
def test_one_row_stays(spark, keep, odd):
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(None, text, 1), (1, text, 2), (None, other, 3), (5, "x y z", 4), (5, "x y z", 4), (5, "q r s", 5), (1, "p q", 6), (None, "k l m", 7), (None, "k l m", 7), (9, None, 8), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group int").selectExpr("*", "1 as _id", "2 as _times", "3 as in_0")
    kept = keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["group"] for r in kept.collect()) == [2, 3, 4, 5, 6, 7, 9]
    assert keep(odd).columns == odd.columns


def test_stage_drops_near_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:100], "other", *words[101:]])), (3, " ".join(words[:100]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()) == [1, 3]
