"""Scoring extracted records against expected ones.

A sample is one attempt at a case: expected and actual JSON texts, the case's
identity fields and whether additional fields are allowed. One pass reads both
texts, which lie in one row, and gives a row for each record of either side, matched
by identity or by position, with its members, at any depth. Differences are
expressions over members; counts are summed for each sample. So texts are never
shuffled, and of records no more than partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.json import STEP, met_rows, once
from textloom.functions.storage import materialize

KEY = ["case_id", "repetition"]
COUNTS = [
    "expected_records", "actual_records", "matched_records", "missing_records", "extra_records",
    "expected_fields", "correct_fields", "incorrect_fields", "missing_fields", "unexpected_fields",
]


def _shown(at: Column, path: Column) -> Column:
    """A path as differences show it: $, the record in brackets, and the members."""
    return F.concat(F.lit("$"), F.when(at == "", F.lit("")).otherwise(F.concat(F.lit("["), at, F.lit("]"))), F.replace(path, F.lit(STEP), F.lit(".")))


#: What a sample has beside its texts.
ABOUT = ["tier", "schema_valid", "allow_additional_fields", "asked"]


def compared(samples: DataFrame) -> DataFrame:
    """Rows KEY, ABOUT, json_valid, shape, unique, at, expected_pos, actual_pos, members, found: one for each sample, without `at`, and for each record.

    found: the differences of matched records, each with path, kind (value, type,
    missing_field or unexpected_field), expected and actual.
    """
    given = samples.withColumn("asked", F.coalesce(F.size("identity_fields") > 0, F.lit(False)))
    rows = met_rows(given, [*KEY, *ABOUT], "expected", "actual", "identity_fields")
    matched = F.col("expected_pos").isNotNull() & F.col("actual_pos").isNotNull()

    def difference(m: Column) -> Column:
        kind = (
            F.when(m["objects"], F.lit(None)).when(m["actual"].isNull(), "missing_field").when(m["expected"].isNull(), "unexpected_field")
            .when(m["expected"].startswith("{"), "type").when(m["expected"] != m["actual"], "value")
        )
        return F.struct(m["path"].alias("path"), kind.alias("kind"), F.coalesce(m["expected"], F.lit("")).alias("expected"), F.coalesce(m["actual"], F.lit("")).alias("actual"))

    allowed = F.coalesce(F.col("allow_additional_fields"), F.lit(False))
    found = F.filter(F.transform("members", difference), lambda d: d["kind"].isNotNull() & ~(allowed & (d["kind"] == "unexpected_field")))
    json_valid = ~F.col("shape").isin("invalid_expected", "invalid_json")
    rows = rows.withColumn("json_valid", json_valid).withColumn("schema_valid", F.col("schema_valid") & F.col("json_valid"))
    return once(rows, F.when(matched, found).otherwise(F.filter(found, lambda _: F.lit(False))), "found")


def _counts() -> dict[str, Column]:
    """What a row of compared() adds to its sample's COUNTS."""
    kinds = F.col("found")["kind"]
    of = lambda *names: F.size(F.filter(kinds, lambda k: k.isin(*names)))
    here = lambda side: F.col(f"{side}_pos").isNotNull()
    matched = here("expected") & here("actual")
    expected = F.filter("members", lambda m: (m["path"] != "") & (m["objects"] | m["expected"].isNotNull()))

    # every expected member above a difference, or at it, is not correct
    def above(d: Column) -> Column:
        steps = F.split(d["path"], STEP)
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), STEP))

    wrong = F.flatten(F.transform("found", above))
    correct = F.when(F.size("found") == 0, F.size(expected)).otherwise(F.size(F.array_except(F.transform(expected, lambda m: m["path"]), wrong)))
    one = lambda when: when.cast("int")
    return {
        "expected_records": one(here("expected")), "actual_records": one(here("actual")), "matched_records": one(matched),
        "missing_records": one(here("expected") & ~here("actual")), "extra_records": one(here("actual") & ~here("expected")),
        "expected_fields": F.when(matched, F.size(expected)), "correct_fields": F.when(matched, correct),
        "incorrect_fields": of("value", "type"), "missing_fields": of("missing_field"), "unexpected_fields": of("unexpected_field"),
    }


def _moved() -> Column:
    """Whether a record isn't at the same place on both sides."""
    return F.col("at").isNotNull() & ~F.col("expected_pos").eqNullSafe(F.col("actual_pos"))


def _fell_back() -> Column:
    return (F.col("shape") == "array") & F.col("asked") & ~F.col("unique")


def scores(rows: DataFrame) -> DataFrame:
    """Of rows of compared(): one row per sample."""
    same = ["tier", "json_valid", "schema_valid", "shape", "asked", "unique"]
    added = rows.select(*KEY, *same, _moved().cast("int").alias("_moved"), *[c.alias(n) for n, c in _counts().items()])
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "_moved")]
    out = added.groupBy(*KEY, *same).agg(*sums)
    clean = sum((F.col(c) for c in ("missing_records", "extra_records", "incorrect_fields", "missing_fields", "unexpected_fields")), F.lit(0)) == 0
    order = (
        F.when(F.col("shape") == "single", F.lit(True)).when(F.col("shape") != "array", F.lit(False)).when(F.col("unique"), F.col("_moved") == 0)
        .otherwise(clean & F.col("schema_valid") & ~_fell_back())
    )
    out = out.withColumn("order_correct", order).withColumn("exact_match", F.col("schema_valid") & clean & F.col("order_correct"))
    return out.select(*KEY, "tier", "json_valid", "schema_valid", "order_correct", *COUNTS, "exact_match")


def differences(rows: DataFrame) -> DataFrame:
    """Of rows of compared(): one row per difference."""
    text = lambda side: F.coalesce(F.get("members", F.lit(0))[side], F.lit(""))
    note = lambda when, what, expected, actual: F.when(when, F.struct(F.lit("$").alias("path"), F.lit(what).alias("kind"), expected.alias("expected"), actual.alias("actual")))
    whole = F.array(
        note(F.col("shape") == "invalid_expected", "invalid_expected", F.lit("valid JSON"), F.lit("")),
        note(F.col("shape") == "invalid_json", "invalid_json", F.lit("valid JSON"), text("actual")),
        note(F.col("json_valid") & ~F.col("schema_valid"), "schema_validation", F.lit("schema-valid JSON"), F.lit("")),
        note(F.col("shape") == "type", "type", text("expected"), text("actual")),
        note(_fell_back(), "identity", F.lit("records with unique identity fields"), F.lit("missing or duplicate identity")),
    )
    kind_of = F.when(F.col("actual_pos").isNull(), F.lit("missing_record")).when(F.col("expected_pos").isNull(), F.lit("extra_record"))
    lost = F.array(F.struct(_shown(F.col("at"), F.lit("")).alias("path"), kind_of.alias("kind"), text("expected").alias("expected"), text("actual").alias("actual")))
    fields = F.transform("found", lambda d: F.struct(_shown(F.col("at"), d["path"]).alias("path"), d["kind"].alias("kind"), d["expected"].alias("expected"), d["actual"].alias("actual")))
    each = F.when(F.col("at").isNull(), F.filter(whole, lambda x: x.isNotNull())).when(kind_of.isNotNull(), lost).otherwise(fields)
    notes = rows.select(*KEY, F.explode(each).alias("d")).select(*KEY, "d.*")

    # the records' names, of samples alone where one is elsewhere
    named = rows.filter("unique and at is not null")
    moved = named.filter(_moved()).select(*KEY).distinct()
    in_order = lambda side: F.array_sort(F.collect_list(F.when(F.col(f"{side}_pos").isNotNull(), F.struct(f"{side}_pos", "at"))))
    names = lambda side: F.to_json(F.transform(in_order(side), lambda x: x["at"])).alias(side)
    order = named.select(*KEY, "at", "expected_pos", "actual_pos").join(moved, KEY, "left_semi").groupBy(*KEY).agg(names("expected"), names("actual"))
    order = order.select(*KEY, F.lit("$").alias("path"), F.lit("order").alias("kind"), "expected", "actual")

    return notes.unionByName(order)


def score(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores, one row per sample, and differences, one row each.

    `samples`: case_id, repetition, tier, identity_fields, allow_additional_fields,
    expected, actual, schema_valid. (case_id, repetition) is unique. Scores add
    json_valid, order_correct, the COUNTS and exact_match to tier and schema_valid.
    Differences: case_id, repetition, path, kind, expected, actual.

    A null or broken actual text is `invalid_json` with all counts 0. Records are
    matched by the identity fields if the case has some and every record on both
    sides has a tuple of its own; otherwise by position, an `identity` difference
    being left if the case has some. A field counts as correct if nothing below it
    differs, and counts beside the fields below it.

    Compared records are written once, as both results read them. For one of the
    results alone, scores() or differences() of compared() write nothing.
    """
    rows = materialize(compared(samples))
    return scores(rows), differences(rows)
