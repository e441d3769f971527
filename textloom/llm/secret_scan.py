"""Secret scanning with a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query. The index holds
postings (trigram, document) for the trigrams that the rules ask for, over all
documents and whole texts. A text has postings for an alternative's trigrams only if
it has the rarest of them, so that most trigrams needn't be looked for in most texts;
joining the index with the queries and keeping documents with every trigram of an
alternative intersects the postings. Only candidates
are run through a rule's expression; a rule without mandatory trigrams is run
over every document.

Positions are found without leaving Spark's functions: matches are wrapped in a
mark, the text is split there, and lengths add up to code-point offsets.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import lower_ascii, materialize
from textloom.llm.trigrams import rarest_first, trigram_query

#: Not matched by any rule; one in a text is taken for OTHER, which no rule matches either.
MARK, OTHER = "\x01", "\x02"


class Rule(NamedTuple):
    """A kind of secret: a match counts if `group` has `least` characters or more.

    `search` finds the same matches as `pattern`, as group 2 after what leads up to them, reading a text's runs once.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    search: str = ""


BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # a run of these characters is matched whole, so asking for its length here drops the same runs as a check afterwards
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    # `search` looks at what follows a run once, at its start: its first `eyJ` matches if any does
    Rule(
        "web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
        search=r"((?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})[A-Za-z0-9_-]*?)"
        r"(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})",
    ),
    Rule("forge_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("pay_key", r"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    # `search` goes from the start of a run of these characters to its first letter, so that a long run is read once
    Rule(
        "url_login", r"(?<![a-z])[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@",
        search=r"((?<![a-z0-9+.-])[0-9+.-]*)([a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@)",
    ),
)
RULES = BASE_RULES + MORE_RULES


def candidates(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows doc_id, kinds: the indexed rules that a document may match."""
    asked = [(r.kind, i, t) for r in rules for i, alt in enumerate(trigram_query(r.pattern) or []) for t in alt]
    if not asked:
        return documents.select("doc_id", F.lit(None).cast("array<string>").alias("kinds")).limit(0)
    # a fixed table, as large as the rules
    queries = documents.sparkSession.createDataFrame(asked, "kind string, alternative int, trigram string")
    needs = queries.groupBy("kind", "alternative").agg(F.count("*").alias("needed"))

    low = documents.select("doc_id", lower_ascii(F.col("text")).alias("low"))
    holds = lambda t: F.contains(F.col("low"), t)
    alternatives = sorted({tuple(rarest_first(alt)) for r in rules for alt in trigram_query(r.pattern) or []})
    each = [F.when(holds(F.lit(alt[0])), F.filter(F.array(*map(F.lit, alt)), holds)) for alt in alternatives]
    held = F.array_distinct(F.flatten(F.array_compact(F.array(*each))))
    postings = low.select("doc_id", F.explode(held).alias("trigram"))
    hits = postings.join(F.broadcast(queries), "trigram").groupBy("doc_id", "kind", "alternative").agg(F.count_distinct("trigram").alias("n"))
    whole = hits.join(F.broadcast(needs), ["kind", "alternative"]).filter(F.col("n") == F.col("needed"))
    return whole.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _cut(parts: Column) -> Column:
    """`parts` in stretches of STRETCH_PARTS: structs parts, chars. Texts without a match have one part: no stretch."""
    stretches = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STRETCH_PARTS).cast("int"))
    chars = lambda some: F.aggregate(some, F.lit(0), lambda n, part: n + F.char_length(part))
    cut = F.transform(F.transform(stretches, lambda i: F.slice(parts, i * STRETCH_PARTS + 1, STRETCH_PARTS)), lambda some: F.struct(some.alias("parts"), chars(some).alias("chars")))
    return F.when(F.size(parts) > 1, cut).otherwise(F.array().cast("array<struct<parts:array<string>,chars:int>>"))


def _starts(cut: Column) -> Column:
    """The offset at which each stretch starts."""
    step = lambda acc, some: F.struct((acc["at"] + some["chars"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))
    return F.aggregate(cut, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda acc: acc["starts"])


def _spans(cut: Column, starts: Column, rule: Rule, order: int) -> Column:
    """Array of structs start, rank, end, kind for one rule, by start; offsets in code points, end exclusive.

    Within a stretch spans are found one after another; as stretches are short, adding to
    an array costs little, and the work is in proportion to the number of matches.
    """
    step = lambda acc, part: F.struct(
        (acc["i"] + 1).alias("i"),
        (acc["at"] + F.char_length(part)).cast("int").alias("at"),
        F.when(
            (acc["i"] % 2 == 1) & _counts(part, rule),
            F.concat(acc["found"], F.array(_span(acc["at"], part, rule, order))),
        ).otherwise(acc["found"]).alias("found"),
    )
    begin = lambda at: F.struct(F.lit(0).alias("i"), at.alias("at"), F.array().cast(SPANS).alias("found"))
    return F.flatten(F.zip_with(cut, starts, lambda some, at: F.aggregate(some["parts"], begin(at), step, lambda acc: acc["found"])))


#: Even, so that every second part is a match in each stretch.
STRETCH_PARTS = 128
SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _counts(part: Column, rule: Rule) -> Column:
    return F.char_length(F.regexp_extract(part, rule.pattern, rule.group)) >= rule.least


def _span(at: Column, part: Column, rule: Rule, order: int) -> Column:
    return F.struct(
        at.alias("start"), F.lit(order).alias("rank"), (at + F.char_length(part)).cast("int").alias("end"), F.lit(rule.kind).alias("kind")
    )


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`doc_id` and `spans`, one row per input row: all secrets of the rules.

    spans is an array of structs start, rank, end, kind, sorted by start and then
    by the rules' order; matches are leftmost and non-overlapping for each rule,
    and dropped if too short. A null or empty text has none. Rows with equal or
    null doc_ids share candidates but each is searched in its own text. An empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(candidates(docs, rules))
    d, c = docs.alias("d"), found.alias("c")
    joined = d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left").select("d.doc_id", F.translate("d.text", MARK, OTHER).alias("text"), F.col("c.kinds").alias("kinds"))
    parts = []
    for rule in rules:
        marked = F.regexp_replace("text", rule.search, f"$1{MARK}$2{MARK}") if rule.search else F.regexp_replace("text", rule.pattern, f"{MARK}$0{MARK}")
        here = F.split(marked, MARK)
        if trigram_query(rule.pattern) is not None:
            here = F.when(F.array_contains("kinds", rule.kind), here).otherwise(F.array().cast("array<string>"))
        parts.append(here.alias(f"parts_{rule.kind}"))
    cuts = joined.select("doc_id", *parts).select("doc_id", *[_cut(F.col(f"parts_{r.kind}")).alias(f"cut_{r.kind}") for r in rules])
    begun = cuts.select("*", *[_starts(F.col(f"cut_{r.kind}")).alias(f"starts_{r.kind}") for r in rules])
    spans = [_spans(F.col(f"cut_{r.kind}"), F.col(f"starts_{r.kind}"), r, order) for order, r in enumerate(rules)]
    return begun.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the base rules' counts, the SHA-256 of their spans, and all spans as text."""
    base = F.array(*[F.lit(r.kind) for r in BASE_RULES])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined(F.filter("spans", lambda s: F.array_contains(base, s["kind"]))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
