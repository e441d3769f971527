"""Evaluating an extractor on a corpus: samples, scores, summaries, reports."""

from __future__ import annotations

import json
import platform
import subprocess
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import textloom
from textloom.functions.json import elements, last_key_wins, strict_json
from textloom.functions.text import encode_delimiter
from textloom.model import Config, Request
from textloom.operators.metrics import quality_summary
from textloom.operators.score import score
from textloom.plans.engine import Engine, ExtractionError, extract_each
from textloom.plans.extractors import Extractor
from textloom.sources.corpus import check_by_schema
from textloom.sources.text import from_text

SAMPLE = "case_id string, repetition int, actual string, failure string, seconds double"
#: Result of one run of a case: JSON text or null, failure or null.
Runner = Callable[[dict], tuple[str | None, str | None]]


@dataclass(frozen=True)
class Evaluation:
    samples: DataFrame
    scores: DataFrame
    differences: DataFrame
    summary: DataFrame


def engine_runner(spark: SparkSession, extractor: Extractor, config: Config | None = None, max_tokens: int = 2048) -> Runner:
    """Runs cases through the engine in this session; a failure gives no output."""
    engine = Engine(extractor, config)

    def run(case: dict) -> tuple[str | None, str | None]:
        request = Request(case["schema"], case["delimiter"] or "\n", max_tokens)
        try:
            done = engine.extract(from_text(spark, case["input"]), request)
        except ExtractionError as e:
            return None, str(e)
        items = [r["v"] for r in done.items.orderBy("source_index", "chunk_in_source", "path", "item_pos").select(F.to_json("value").alias("v")).collect()]
        return (f"[{','.join(items)}]" if done.prepared.is_array else items[0]), None

    return run


def subprocess_runner(command: list[str]) -> Runner:
    """Runs a command line for every sample, given schema file and delimiter as options and the input as standard input.

    Output is scored even if the command fails; its exit and error output are the failure.
    """
    import tempfile

    def run(case: dict) -> tuple[str | None, str | None]:
        with tempfile.NamedTemporaryFile("w", suffix=".json") as f:
            f.write(case["schema"])
            f.flush()
            given = [*command, "--schema", f.name, "--delimiter", encode_delimiter(case["delimiter"] or "\n"), "--compact"]
            done = subprocess.run(given, input=case["input"], capture_output=True, text=True, check=False)
        return done.stdout or None, None if done.returncode == 0 else f"exit {done.returncode}: {done.stderr.strip()}"

    return run


def run_samples(cases: DataFrame, runner: Runner, repetitions: int = 1, warmups: int = 0) -> DataFrame:
    """Rows of SAMPLE: every case `repetitions` times, in order, after `warmups` runs of it that don't count.

    A corpus is a small set of hand-made cases; the work of each is the engine's.
    """
    if repetitions < 1 or warmups < 0:
        raise ValueError("repetitions must be 1 or more, warm-ups 0 or more")
    out = []
    for case in [r.asDict() for r in cases.orderBy("case_pos").collect()]:
        for _ in range(warmups):
            runner(case)
        for repetition in range(1, repetitions + 1):
            began = time.perf_counter()
            actual, failure = runner(case)
            out.append((case["case_id"], repetition, actual, failure, time.perf_counter() - began))
    return cases.sparkSession.createDataFrame(out, SAMPLE)


def engine_samples(cases: DataFrame, extractor: Extractor, config: Config | None = None, max_tokens: int = 2048, repetitions: int = 1) -> DataFrame:
    """Rows of SAMPLE for every case and repetition in one plan; seconds are null, as cases run side by side.

    There is one extraction for each distinct schema and delimiter, over all cases
    that have them. To time cases one by one, take run_samples().
    """
    if repetitions < 1:
        raise ValueError("repetitions must be 1 or more")
    delimiter = F.coalesce(F.nullif("delimiter", F.lit("")), F.lit("\n"))
    rows = cases.select("case_id", "case_pos", "schema", delimiter.alias("delimiter"), "input")
    rows = rows.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    rows = rows.withColumn("source_index", (F.col("case_pos") * repetitions + F.col("repetition") - 1).cast("int"))
    found = cases.sparkSession.createDataFrame([], "source_index int, actual string, failure string")
    for asked in rows.select("schema", "delimiter").distinct().orderBy("schema", "delimiter").collect():
        own = rows.filter((F.col("schema") == asked["schema"]) & (F.col("delimiter") == asked["delimiter"]))
        request = Request(asked["schema"], asked["delimiter"], max_tokens)
        found = found.unionByName(extract_each(own.select("source_index", F.col("input").alias("content")), extractor, request, config))
    joined = rows.join(found.withColumn("_ran", F.lit(True)), "source_index", "left")
    failure = F.when(F.col("_ran").isNull(), F.lit("no input")).otherwise(F.col("failure"))
    return joined.select("case_id", "repetition", "actual", failure.alias("failure"), F.lit(None).cast("double").alias("seconds"))


def score_samples(cases: DataFrame, samples: DataFrame) -> Evaluation:
    """Score samples (SAMPLE) of `cases`, and sum the scores up.

    scores add failure, valid (exact, and without failure) and all_expected_records,
    the number of records a case expects whether or not its extraction succeeded.
    """
    last_key_wins(cases.sparkSession)
    columns = ["case_id", "tier", "identity_fields", "allow_additional_fields", "expected", "schema"]
    joined = samples.join(cases.select(*columns), "case_id")
    joined = joined.withColumn("identity_fields", F.coalesce("identity_fields", F.array().cast("array<string>"))).fillna(False, ["allow_additional_fields"])
    checked = check_by_schema(joined, "actual").withColumn("schema_valid", F.col("error").isNull()).drop("value", "error")
    scores, differences = score(checked)
    value = strict_json(F.col("expected"))
    wanted = checked.select("case_id", "repetition", "failure", "seconds", F.coalesce(F.size(elements(value)), F.lit(1)).cast("long").alias("all_expected_records"))
    scores = scores.join(wanted, ["case_id", "repetition"]).withColumn("valid", F.col("exact_match") & F.col("failure").isNull())
    return Evaluation(samples, scores, differences, quality_summary(scores))


def metadata(spark: SparkSession, extractor: str, config: Config) -> dict:
    """What a report was made with."""
    return {
        "version": textloom.__version__, "spark": spark.version, "python": platform.python_version(), "platform": platform.platform(),
        "parallelism": spark.sparkContext.defaultParallelism, "extractor": extractor, "context": config.context, "enforce_shape": config.enforce_shape,
        "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "executable": sys.executable,
    }


def report_rows(evaluation: Evaluation) -> DataFrame:
    """The scores, each with the list of its differences."""
    d = evaluation.differences
    each = d.groupBy("case_id", "repetition").agg(F.array_sort(F.collect_list(F.struct("path", "kind", "expected", "actual"))).alias("differences"))
    return evaluation.scores.join(each, ["case_id", "repetition"], "left")


def report(evaluation: Evaluation, about: dict) -> str:
    """One JSON document: metadata, summary, and each sample's score with its differences, in order. For corpora that one reader can hold."""
    rows = report_rows(evaluation).orderBy("case_id", "repetition").toJSON().collect()
    summary = evaluation.summary.toJSON().first()
    return json.dumps({"metadata": about, "summary": json.loads(summary), "samples": [json.loads(r) for r in rows]}, sort_keys=True)


def write_report(evaluation: Evaluation, about: dict, path: str) -> None:
    """The same in parallel, for a corpus of any size: JSON Lines in `path`/samples, sorted, and metadata and summary in `path`/summary."""
    report_rows(evaluation).repartitionByRange("case_id", "repetition").sortWithinPartitions("case_id", "repetition").write.json(f"{path}/samples")
    summary = evaluation.summary.select(F.to_json(F.struct("*")).alias("_s"))
    told = F.concat(F.lit('{"metadata":' + json.dumps(about, sort_keys=True) + ',"summary":'), "_s", F.lit("}"))
    summary.select(told.alias("value")).write.text(f"{path}/summary")
