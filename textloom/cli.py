"""Command line: text from files or standard input to JSON on standard output.

    python -m textloom.cli --extractor 'rule:(?<host>\\S+) is (?<status>\\w+)' --fields host,status access.log
"""

from __future__ import annotations

import argparse
import functools
import importlib
import json
import re
import sys
import time
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import textloom
from textloom.functions.text import decode_delimiter
from textloom.model import Config, Request
from textloom.operators.metrics import throughput
from textloom.operators.schema import choose_schema
from textloom.plans.engine import Engine, ExtractionError, NoInput
from textloom.plans.extractors import Extractor, JsonExtractor, ModelExtractor, RuleExtractor
from textloom.sinks.json import write_array, write_document
from textloom.sources.text import from_files, from_text

ORDER = ["source_index", "chunk_in_source", "path", "item_pos"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description="Extract schema-validated JSON from text.")
    p.add_argument("paths", nargs="*", help="input files, in order; standard input if none")
    p.add_argument("--schema", metavar="FILE", help="JSON Schema of the result")
    p.add_argument("--fields", help="comma-separated names of required string fields, instead of a schema")
    p.add_argument("--extractor", default="json", help="json, rule:REGEX with groups named like fields, or model:MODULE:FACTORY")
    p.add_argument("--max-tokens", type=int, default=2048)
    p.add_argument("--ctx", type=int, default=8192, help="tokens of prompt and output together")
    p.add_argument("--delimiter", default="\\n", help="what ends records; knows \\n \\t \\r \\0 \\\\")
    p.add_argument("--compact", action="store_true")
    p.add_argument("--atomic", action="store_true", help="write nothing unless all succeeds")
    p.add_argument("--no-grammar", action="store_true", help="leave a model's output unconstrained; it is validated all the same")
    p.add_argument("--threads", type=int, default=4)
    p.add_argument("--device", choices=("auto", "cpu", "gpu"), default="auto", help="passed to a model's factory")
    p.add_argument("--gpu-layers", type=int, default=-1, help="passed to a model's factory")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--version", action="store_true")
    p.add_argument("--report", action="store_true", help="describe engine and session as JSON")
    return p


def extractor_of(options: argparse.Namespace) -> Extractor:
    kind, _, rest = options.extractor.partition(":")
    if kind == "json":
        return JsonExtractor()
    if kind == "rule":
        # Java and Python write named groups differently, and count them alike
        names = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", rest)).groupindex
        if not names:
            raise ValueError("the rule has no named groups")
        return RuleExtractor(re.sub(r"\(\?P<", "(?<", rest), dict(names))
    if kind == "model":
        module, _, name = rest.rpartition(":")
        factory = getattr(importlib.import_module(module), name)
        return ModelExtractor(functools.partial(factory, device=options.device, gpu_layers=options.gpu_layers, constrained=not options.no_grammar))
    raise ValueError(f"unknown extractor {kind!r}")


def run(argv: list[str], stdin: TextIO, stdout: TextIO, stderr: TextIO, spark: SparkSession | None = None) -> int:
    """The exit code: 0, 1 for a failure (standard output may then hold part of an array), 2 for wrong options."""
    options = parser().parse_args(argv)
    if options.version:
        stdout.write(f"textloom {textloom.__version__}\n")
        return 0
    own = spark is None
    spark = spark or session(options.threads)
    try:
        if options.report:
            about = {"version": textloom.__version__, "spark": spark.version, "master": spark.sparkContext.master, "parallelism": spark.sparkContext.defaultParallelism}
            write_document(json.dumps(about), stdout, options.compact)
            return 0
        return _extract(options, spark, stdin, stdout, stderr)
    except (ValueError, OSError) as e:
        stderr.write("No input\n" if isinstance(e, NoInput) else f"error: {e}\n")
        return 1
    finally:
        if own:
            spark.stop()


def _extract(options: argparse.Namespace, spark: SparkSession, stdin: TextIO, stdout: TextIO, stderr: TextIO) -> int:
    if options.schema is not None:
        with open(options.schema, encoding="utf-8") as f:
            schema = choose_schema(f.read())
    else:
        schema = choose_schema(fields=options.fields)
    request = Request(schema, decode_delimiter(options.delimiter), options.max_tokens)
    engine = Engine(extractor_of(options), Config(options.ctx, not options.no_grammar))
    sources = from_files(spark, options.paths) if options.paths else from_text(spark, stdin.read())
    began = time.perf_counter()
    done = engine.attempt(sources, request)
    if options.atomic or not done.prepared.is_array:
        done.raise_for_error()
    if done.prepared.is_array:
        write_array(done.items, ORDER, stdout, options.compact)
    else:
        write_document(done.items.select(F.to_json("value").alias("v")).first()["v"], stdout, options.compact)
    if options.verbose:
        stderr.write(throughput(done.metrics(), time.perf_counter() - began).toJSON().first() + "\n")
    done.raise_for_error()
    return 0


def session(threads: int) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{threads}]").config("spark.sql.shuffle.partitions", threads)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.log.level", "ERROR").getOrCreate()
    )


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], sys.stdin, sys.stdout, sys.stderr))
