"""A corpus of extraction cases: a manifest, and a folder of files for each case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.json import last_key_wins, once, with_json
from textloom.functions.storage import materialize

MANIFEST = "version int, model string, cases array<string>"
CASE = "id string, description string, tier string, tags array<string>, delimiter string, identity_fields array<string>, comparison string, allow_additional_fields boolean, normalizers map<string,string>"
TIERS = ("conformance", "capability")
COMPARISONS = ("ordered", "positional")


class CorpusError(ValueError):
    """What is wrong with a corpus, one line for each violation."""


def read_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Rows case_pos, case_id, the fields of CASE, input, schema, expected; not yet checked.

    case_pos is the place in the manifest. A file that is missing is null; the
    input is input.txt or else input.bin.
    """
    last_key_wins(spark)
    manifest = spark.read.schema(MANIFEST).json(f"{root}/manifest.json", multiLine=True)
    listed = manifest.select("version", F.size("cases").alias("n_cases"), F.posexplode("cases").alias("case_pos", "case_id"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,txt,bin}").load(f"{root}/cases/*")
    parts = F.split(F.regexp_replace("path", "/+$", ""), "/")
    files = files.select(F.element_at(parts, -2).alias("case_id"), F.element_at(parts, -1).alias("name"), F.decode("content", "UTF-8").alias("content"))
    by_case = files.groupBy("case_id").agg(*[F.max(F.when(F.col("name") == n, F.col("content"))).alias(c) for c, n in (("case_json", "case.json"), ("txt", "input.txt"), ("bin", "input.bin"), ("schema", "schema.json"), ("expected", "expected.json"))])
    joined = listed.join(by_case, "case_id", "left").withColumn("c", F.from_json("case_json", CASE))
    return joined.select("version", "case_pos", "case_id", "c.*", F.coalesce("txt", "bin").alias("input"), "schema", "expected")


def violations(cases: DataFrame) -> DataFrame:
    """Rows case_id, problem: what is wrong with the manifest's and the cases' form."""
    rules = {
        "version is less than 1": F.coalesce(F.col("version"), F.lit(0)) < 1,
        "unsafe id": ~F.coalesce(F.col("case_id").rlike(r"^[^/\\]+$") & ~F.col("case_id").isin(".", ".."), F.lit(False)),
        "case.json is missing or broken": F.col("id").isNull() & F.col("description").isNull(),
        "id differs from the manifest's": F.col("id").isNotNull() & (F.col("id") != F.col("case_id")),
        "id and description are required": (F.coalesce("id", F.lit("")) == "") | (F.coalesce("description", F.lit("")) == ""),
        "unknown tier": ~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False)),
        "unknown comparison": ~F.coalesce(F.col("comparison").isin(*COMPARISONS), F.lit(False)),
        "no input": F.col("input").isNull(),
        "no schema": F.col("schema").isNull(),
        "no expected result": F.col("expected").isNull(),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(p)) for p, c in rules.items()]), lambda p: p.isNotNull())
    each = cases.select("case_id", F.explode(found).alias("problem"))
    twice = cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1").select("case_id", F.lit("listed more than once").alias("problem"))
    return each.unionByName(twice)


def load_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The cases of a corpus in manifest order of case_pos, all of them sound: form, and expected results against schemas.

    Raises CorpusError otherwise, with the first hundred problems. Schemas differ from
    case to case, so that each distinct schema is compiled once and checks its own cases.
    """
    cases = materialize(read_corpus(spark, root))
    problems = [f"{r['case_id']}: {r['problem']}" for r in violations(cases).orderBy("case_id", "problem").limit(100).collect()]
    if cases.isEmpty():
        problems = ["the manifest lists no cases"]
    if problems:
        raise CorpusError("\n".join(problems))
    checked = check_by_schema(cases, "expected")
    broken = checked.filter("error is not null").select("case_id", "error").orderBy("case_id").limit(100).collect()
    if broken:
        raise CorpusError("\n".join(f"{r['case_id']}: expected: {r['error']}" for r in broken))
    return cases.drop("version", "id")


def check_by_schema(rows: DataFrame, text: str) -> DataFrame:
    """`rows` with value and error of column `text` under each row's own column `schema`.

    Each distinct schema is compiled once, as a branch of one expression, so that
    rows are read and parsed once for SCHEMAS_AT_ONCE schemas; a row with a null
    schema is checked for being JSON only.
    """
    from textloom.operators.schema import prepare
    from textloom.operators.validate import message, violations

    schemas = [r["schema"] for r in rows.select("schema").filter("schema is not null").distinct().orderBy("schema").collect()]
    kept = [c for c in rows.columns if c not in ("value", "error")]
    value, found = F.col("value"), None
    for at in range(0, max(1, len(schemas)), SCHEMAS_AT_ONCE):
        some = schemas[at : at + SCHEMAS_AT_ONCE]
        own = F.col("schema").isin(some) if at else F.col("schema").isin(some) | F.col("schema").isNull()
        broken = F.lit(None).cast("array<struct<path:string,keyword:string>>")
        for schema in some:
            broken = F.when(F.col("schema") == schema, violations(value, prepare(schema).schema)).otherwise(broken)
        checked = once(with_json(rows.filter(own), text, "_parsed").select(*kept, F.col("_parsed").alias("value")), broken, "_broken")
        one = checked.withColumn("error", F.when(value.isNull(), F.lit("invalid JSON")).otherwise(message(F.col("_broken")))).drop("_broken")
        found = one if found is None else found.unionByName(one)
    return found


#: Schemas that are branches of one expression.
SCHEMAS_AT_ONCE = 50
