"""Language ID by held-out accuracy; token counts, mixing and packing against plain versions."""

import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from textloom.llm import language_id, packing, source_mixing, token_counts
from textloom.llm.common import table

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    found = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert found.keys() == truth.keys()
    held = [i for i, r in found.items() if r["held_out"]]
    assert 0.25 < len(held) / len(found) < 0.42
    assert sum(found[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_looks_at_text_alone(spark):
    docs = table(spark, SF, "documents")
    seen = language_id.train(docs.filter(~language_id.held_out()))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "doc_id": F.col("doc_id") + 1000000})
    a = language_id.predict(docs, seen, ["text"]).select("text", "lang_pred", "score").distinct()
    b = language_id.predict(other, seen, ["text"]).select("text", "lang_pred", "score").distinct()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_language_odd_rows(odd, odd_rows, empty):
    got = language_id.identify(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in odd_rows)
    no_letter = {1, 2, 3, 15}
    assert all((r["lang_pred"] == "und" and r["score"] == 0) == (r["doc_id"] in no_letter) for r in got if r["doc_id"] is not None)
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 2, 3, 15)").count() == 0


def test_grams_do_not_depend_on_stretches(monkeypatch):
    text = "".join(random.Random(1).choices("abc dé😀", k=5000))
    whole = Counter(x for part in language_id.grams(text) for x in part.tolist())
    monkeypatch.setattr(language_id, "STRETCH", 100)
    assert whole == Counter(x for part in language_id.grams(text) for x in part.tolist())
    assert sum(whole.values()) == 3 * len(text.lower()) - 3


def test_token_histogram(spark, odd, odd_rows, empty):
    import base64

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = [r["text"] for r in table(spark, SF, "documents").select("text").collect()]
    for df, all_texts in ((table(spark, SF, "documents"), texts), (odd, [t for _, t, _, _ in odd_rows])):
        lengths = [len(encode(t or "")) for t in all_texts]
        histogram = token_counts.length_histogram(token_counts.token_counts(df)).cache()
        rows = {r["n_tokens"]: r for r in histogram.collect()}
        assert rows.keys() == set(lengths)
        for n, r in rows.items():
            assert r["docs"] == lengths.count(n) and r["tokens"] == n * lengths.count(n)
            assert r["docs_from"] == sum(x >= n for x in lengths) and r["tokens_from"] == sum(x for x in lengths if x >= n)
            assert r["docs_below"] == sum(x < n for x in lengths) and r["tokens_below"] == sum(x for x in lengths if x < n)
            assert r["truncated_total"] == sum(min(x, n) for x in lengths)
            assert r["share"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
        assert token_counts.truncated_total(histogram, 100) == (sum(min(x, 100) for x in lengths), sum(x > 100 for x in lengths))
        assert token_counts.quantile(histogram, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    nothing = token_counts.length_histogram(token_counts.token_counts(empty))
    assert nothing.count() == 0 and token_counts.quantile(nothing, 0.5) is None and token_counts.truncated_total(nothing, 5) == (0, 0)


def plain_schedule(blocks, weights):
    """Earliest deadline first with exact fractions, by looking at every source in every slot."""
    time = lambda v: sum(min(Fraction(n), w * v) for n, w in zip(blocks, weights, strict=True))
    placed, out = [0] * len(blocks), []
    for slot in range(sum(blocks)):
        ready = [k for k, n in enumerate(placed) if n < blocks[k] and int(time(n / weights[k])) <= slot]
        k = min(ready, key=lambda k: (math.ceil(time((placed[k] + 1) / weights[k])), k))
        placed[k] += 1
        out.append(k)
    return out


def ideal_shares(blocks, weights, t):
    """What each source has given after t slots of a mix without blocks."""
    left, given, t = set(range(len(blocks))), [Fraction(0)] * len(blocks), Fraction(t)
    while t > 0 and left:
        rate = sum(weights[k] for k in left)
        step = min(t, *((blocks[k] - given[k]) * rate / weights[k] for k in left))
        for k in left:
            given[k] += step * weights[k] / rate
        t -= step
        left = {k for k in left if given[k] < blocks[k]}
    return given


def test_schedule_is_earliest_deadline_first():
    rng = random.Random(5)
    for most in [60] * 20 + [8] * 60:  # few blocks: sources run out soon
        n = rng.randrange(1, 9)
        blocks = [rng.randrange(1, most) for _ in range(n)]
        weights = [rng.choice([rng.random() + 0.01, rng.randrange(1, 5), 1e-9]) for _ in range(n)]
        exact = [Fraction(w) for w in weights]
        got = source_mixing.schedule(blocks, weights).tolist()
        assert got == plain_schedule(blocks, exact)
        seen = [0] * n
        for t, k in enumerate(got, 1):
            seen[k] += 1
            assert all(abs(a - b) < 1 for a, b in zip(seen, ideal_shares(blocks, exact, t), strict=True))


def test_sources_without_weight_come_last():
    assert source_mixing.schedule([2, 0, 3, 1], [0, 1, 1, 0]).tolist()[:3] == [2, 2, 2]
    assert sorted(source_mixing.schedule([2, 0, 3, 1], [0, 1, 1, 0]).tolist()[3:]) == [0, 0, 3]
    assert source_mixing.schedule([], []).tolist() == [] and source_mixing.schedule([0, 0], [1, 0]).tolist() == []


def test_long_schedule_stays_by_the_exact_targets():
    """Among them a source so rare that rounded weights would lead it astray; no allowance for drift."""
    blocks = [400_000, 150_000, 50_000, 20, 3]
    weights = [4.0, 1.5, 0.5 + 1e-9, 0.0002, 0.00003]
    who = source_mixing.schedule(blocks, weights)
    exact, total = [Fraction(w) for w in weights], sum(map(Fraction, weights))
    until = int(min(n * total / w for n, w in zip(blocks, exact, strict=True)))
    assert until > 590_000
    for k, w in enumerate(exact):
        # just before and after each of the source's blocks, where it is furthest behind or ahead
        for nth, slot in enumerate(np.flatnonzero(who[:until] == k).tolist()):
            assert -1 < nth - w * slot / total and nth + 1 - w * (slot + 1) / total < 1


def test_more_sources_than_any_bound(spark, monkeypatch):
    monkeypatch.setattr(source_mixing, "BROADCAST_SOURCES", 500)
    docs = spark.range(1400).selectExpr("id as doc_id", "repeat('x', 10 + cast(id % 7 as int)) as text", "concat('s', id % 700) as source")
    rows = source_mixing.mix(docs, block_chars=8).collect()
    assert len(rows) == 1400 and {r["source"] for r in rows} == {f"s{i}" for i in range(700)}


def test_blocks_grow_so_that_the_schedule_is_bounded(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "repeat('x', 1000) as text", "concat('s', id % 3) as source")
    assert max(r["slot"] for r in source_mixing.mix(docs, slots=10).collect()) < 10
    given = source_mixing.mix(docs, {"s1": 3, "s2": Fraction(1, 3)}, block_chars=1000).orderBy("slot").collect()
    assert {r["source"] for r in given[200:]} == {"s0"} and sum(r["source"] == "s1" for r in given[:100]) == 90


def test_numbers_are_no_letters():
    assert [language_id.has_letter(t) for t in ["½ ² Ⅷ 7 _", "", None, "中", "7é"]] == [False, False, False, True, True]


def plain_bayes(labelled, texts):
    """Multinomial naive Bayes with dictionaries: language and posterior for each text."""
    bucket = {}

    def of(text):
        low, out = text.lower(), Counter()
        for n in (1, 2, 3):
            for i in range(len(low) - n + 1):
                g = low[i : i + n]
                if g not in bucket:
                    # the last of the buckets of its grams
                    bucket[g] = int(np.concatenate(list(language_id.grams(g)))[-1])
                out[bucket[g]] += 1
        return out

    counts, docs = defaultdict(Counter), Counter()
    for lang, text in labelled:
        counts[lang] += of(text)
        docs[lang] += 1
    size, found = 1 << language_id.BUCKET_BITS, []
    for text in texts:
        grams, logs = of(text), {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + language_id.SMOOTHING * size
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((counts[lang][g] + language_id.SMOOTHING) / total) for g, n in grams.items())
        best = max(logs, key=logs.get)
        found.append((best, 1 / sum(math.exp(x - logs[best]) for x in logs.values())))
    return found


@pytest.mark.parametrize("at_once", [256, 3])
def test_language_against_plain_bayes(spark, monkeypatch, at_once):
    monkeypatch.setattr(language_id, "LANGUAGES_AT_ONCE", at_once)
    rows = [(r["lang"], r["text"][:300]) for r in table(spark, SF, "documents").filter("lang is not null and text is not null").orderBy("doc_id").limit(260).collect()]
    rows = [(f"{lang}{i % 2}", text) for i, (lang, text) in enumerate(rows)]  # eight languages, in pairs hard to tell apart
    labelled, texts = rows[:200], [t[:40] for _, t in rows[200:] if any(map(str.isalpha, t[:40]))]
    models = language_id.train(spark.createDataFrame(labelled, "lang string, text string"))
    assert len(models) == (1 if at_once == 256 else 3)
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), models, ["i"]).orderBy("i").collect()
    for r, (lang, score) in zip(got, plain_bayes(labelled, texts), strict=True):
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-3)


def test_language_memory_at_the_bound():
    """256 languages and a text of ten million characters."""
    import tracemalloc

    n = language_id.LANGUAGES_AT_ONCE
    weights = np.random.default_rng(1).random((1 << language_id.BUCKET_BITS, n), np.float32)
    model = language_id.Model([str(i) for i in range(n)], np.zeros(n), weights)
    text = "".join(random.Random(2).choices("abcdefghij é", k=100_000)) * 100
    tracemalloc.start()
    logs = model.logs([text, "short", text[:50_000]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6
    for i, t in ((1, "short"), (2, text[:50_000])):
        want = sum(weights[x].sum(axis=0, dtype=np.float64) for x in language_id.grams(t))
        assert np.allclose(logs[i], want, rtol=1e-9)


def test_language_columns_may_have_any_name(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").selectExpr("*", "1 as score", "'x' as lang_pred", "2 as _text", "3 as _best")
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() > 150
    assert kept.exceptAll(docs).count() == 0


@pytest.mark.parametrize("block_chars", [50, 3000, 1 << 16])
def test_mix_keeps_all_rows_and_places_blocks(spark, odd, empty, block_chars):
    for df in (odd, table(spark, SF, "documents")):
        got = source_mixing.mix(df, block_chars=block_chars)
        assert got.columns == [*df.columns, "chars", "block", "slot", "offset"]
        assert got.select(*df.columns).exceptAll(df).count() == 0 and got.count() == df.count()
        rows = got.collect()
        by_source = defaultdict(list)
        for r in rows:
            by_source[r["source"]].append(r)
        slots = {}
        for s, own in by_source.items():
            own.sort(key=lambda r: (r["block"], r["offset"], len(r["text"] or "")))
            at = 0
            for r in own:
                assert r["block"] * block_chars + r["offset"] == at
                at += len(r["text"] or "")
                assert slots.setdefault((s, r["block"]), r["slot"]) == r["slot"]
        assert len(set(slots.values())) == len(slots)
    assert source_mixing.mix(empty).count() == 0 and source_mixing.mixed_order(empty).columns == empty.columns


def fixed_pack(lengths, capacities, costs):
    """The cheapest of best-fit packings that open one length wherever it fits, by looking at every bin."""
    best = None
    for preferred in sorted(capacities):
        used, cap = [], []
        for n in lengths:
            fits = [(cap[b] - used[b], b) for b in range(len(used)) if cap[b] - used[b] >= n]
            if fits:
                used[min(fits)[1]] += n
            else:
                used.append(n)
                cap.append(preferred if preferred >= n else min(c for c in capacities if c >= n))
        cost = sum(min(costs[i] for i, c in enumerate(capacities) if c >= u) for u in used)
        best = cost if best is None else min(best, cost)
    return best


def optimum(lengths, capacities, costs):
    """The cheapest packing of all, over all ways to part the pieces."""
    price = lambda u: min((costs[i] for i, c in enumerate(capacities) if c >= u), default=math.inf)
    sums = [sum(n for i, n in enumerate(lengths) if s >> i & 1) for s in range(1 << len(lengths))]
    best = [0.0] + [math.inf] * (len(sums) - 1)
    for s in range(1, len(sums)):
        low, part = s & -s, s
        while part:
            if part & low and best[s ^ part] < math.inf:
                best[s] = min(best[s], best[s ^ part] + price(sums[part]))
            part = (part - 1) & s
    return best[-1]


def checked_cost(lengths, capacities, costs):
    bins, sizes = packing.pack(lengths, capacities, costs)
    used = Counter()
    for b, n in zip(bins, lengths, strict=True):
        used[b] += n
    assert sorted(used) == list(range(len(sizes))) and all(used[b] <= c for b, c in enumerate(sizes))
    cost = dict(zip(capacities, costs, strict=True))
    assert all(cost[c] == min(k for x, k in cost.items() if x >= used[b]) for b, c in enumerate(sizes))
    return sum(cost[c] for c in sizes)


def test_pack_against_the_optimum_and_against_fixed_sizes():
    rng, dearer, saved = random.Random(2), [], 0
    for trial in range(150):
        capacities = sorted(rng.sample(range(5, 60), rng.randrange(2, 4)))
        costs = [c + rng.randrange(0, 10) for c in capacities]
        n = 8 if trial < 100 else rng.randrange(20, 60)
        lengths = sorted((rng.randrange(1, capacities[-1] + 1) for _ in range(n)), reverse=True)
        cost, fixed = checked_cost(lengths, capacities, costs), fixed_pack(lengths, capacities, costs)
        assert cost <= fixed
        saved += cost < fixed
        if trial < 100:
            dearer.append(cost / optimum(lengths, capacities, costs))
            assert dearer[-1] >= 1
    assert saved > 3 and sum(dearer) / len(dearer) < 1.01 and max(dearer) < 1.2


def test_a_bin_is_opened_at_the_least_cost_for_what_it_would_hold():
    sizes = packing._Sizes([4, 8, 16], [5, 8, 18])
    assert sizes.least_cost([-3, -3, -2], 0) == 8  # 3 + 3 + 2 for 8 beats 3 for 5; 8 in 16 would be downsized to the same
    assert sizes.least_cost([-4, -3], 0) == 8  # 7 for 8 beats 4 for 5
    assert sizes.least_cost([-4], 0) == 4
    assert sizes.least_cost([-9, -7], 0) == 16


@pytest.mark.parametrize("capacities", [(64,), (64, 128, 1000), packing.CAPACITIES])
def test_packing_places_every_character_once(spark, odd, empty, capacities):
    for df in (odd, table(spark, SF, "documents")):
        rows = packing.best_fit(df, capacities=capacities).collect()
        pieces, bins = defaultdict(list), defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append((r["start"], r["length"]))
            if r["bin_id"] is not None:
                bins[r["bin_id"], r["capacity"], r["used"]].append((r["offset"], r["length"]))
            else:
                assert r["length"] == 0
        want = defaultdict(list)
        for r in df.collect():
            n = len(r["text"] or "")
            want[r["doc_id"]] += [(s, min(capacities[-1], n - s)) for s in range(0, n, capacities[-1])] or [(0, 0)]
        assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
        assert len({b for b, _, _ in bins}) == len(bins)
        for (_, capacity, used), own in bins.items():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at == used <= capacity == min(c for c in capacities if c >= used)
    assert packing.best_fit(empty).count() == 0


def test_packing_wastes_little(spark):
    rows = packing.best_fit(table(spark, SF, "documents")).filter("bin_id is not null").select("bin_id", "capacity", "used").distinct()
    r = rows.agg(F.sum("capacity").alias("c"), F.sum("used").alias("u")).first()
    assert r["u"] / r["c"] > 0.95
