"""The engine: extraction, split and retry, numbering, failures, sinks, streams and the command line."""

import io
import json
import math

import pytest
from pyspark.sql import functions as F

from textloom import cli
from textloom.artifacts import Artifact, checksums, install, verify
from textloom.model import Config, Request
from textloom.operators.schema import fields_schema, prepare
from textloom.plans.engine import Engine, ExtractionError, NoInput, extract_groups
from textloom.plans.extractors import JsonExtractor, ModelExtractor, ReplayExtractor, RuleExtractor, first_bytes, json_items, rule_table, typed
from textloom.sinks.json import ArrayWriter, array_documents, write_array, write_document, write_lines
from textloom.sources.text import from_column, from_files, from_text, large_file, whole
from textloom.streaming.stream import extract_stream, file_stream

ORDER = ["source_index", "chunk_in_source", "path", "item_pos"]
STATUS = RuleExtractor(r"^(?<host>\S+) is (?<status>\w+)\.?$", {"host": 1, "status": 2})
SCHEMA = fields_schema("host,status")
#: Context in which prompts of a few bytes fit, and outputs of 60 tokens.
SMALL = Config(context=600 + 60 + 20)


def values(extraction):
    return [json.loads(r["v"]) for r in extraction.items.orderBy(*ORDER).select(F.to_json("value").alias("v")).collect()]


def lines(n):
    return [f"h{i} is {'up' if i % 3 else 'down'}" for i in range(n)]


def hosts(n):
    return [{"host": f"h{i}", "status": "up" if i % 3 else "down"} for i in range(n)]


def test_rule_extraction_keeps_order_and_repeats(spark):
    texts = ["\n".join(lines(3) + lines(3)), "noise\n" + lines(1)[0], ""]
    done = Engine(STATUS).extract(from_text(spark, *texts).repartition(3), Request(SCHEMA))
    assert values(done) == hosts(3) * 2 + hosts(1)
    m = done.metrics().first()
    assert m["records_produced"] == 7 and m["chunks_processed"] == 2 and m["chunks_retried"] == 0
    assert m["input_bytes"] == sum(len(t) for t in texts) and m["output_bytes"] == len(json.dumps(values(done), separators=(",", ":")))


@pytest.mark.parametrize("packed", [False, True])
def test_overflowing_chunks_are_split(spark, packed):
    text = "\n".join(lines(5))
    done = Engine(STATUS, Config(context=600 + 30 + 60)).extract(from_text(spark, text), Request(SCHEMA, max_tokens=30), packed)
    assert values(done) == hosts(5)
    rows = done.attempts.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(1, len(rows) + 1))
    assert any(r["outcome"] == "split" for r in rows) and all(r["retried"] == (r["depth"] > 0) for r in rows)
    # each attempt comes right before its left half, and that half's attempts before the right half
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)
    m = done.metrics().first()
    assert m["chunks_processed"] == len(rows) and m["leaf_input_bytes"] < m["input_bytes"] == sum(r["input_bytes"] for r in rows)


def plain_attempts(text, extract, max_tokens, context):
    """Depth-first, one attempt after another: (depth, text, outcome) and the items, up to the first failure."""
    rows, items = [], []

    def attempt(chunk, depth):
        chunk = chunk.strip()
        if not chunk:
            return True
        raw = extract(chunk)
        long = 600 + math.ceil(len(chunk.encode()) / 3) + max_tokens > context
        # output that just fills the limit is whole all the same
        if not long and len(raw.encode()) <= 3 * max_tokens:
            rows.append((depth, chunk, "ok"))
            items.extend(json.loads(raw))
            return True
        parts = chunk.split("\n")
        if len(parts) > 1:
            half = ["\n".join(parts[: len(parts) // 2]), "\n".join(parts[len(parts) // 2 :])]
        elif len(chunk) > 1:
            half = [chunk[: len(chunk) // 2], chunk[len(chunk) // 2 :]]
        else:
            rows.append((depth, chunk, "failed"))
            return False
        rows.append((depth, chunk, "split"))
        return attempt(half[0], depth + 1) and attempt(half[1], depth + 1)

    attempt(text, 0)
    return rows, items


@pytest.mark.parametrize("max_tokens", [12, 13, 20, 40])
def test_attempts_are_those_of_a_depth_first_worker(spark, max_tokens):
    text = "\n".join(["h1 is up", "", "host-with-a-long-name-0001 is up", "  ", "h2 is down", "x", "h3 is up"])
    config = Config(context=600 + max_tokens + 30)

    def extract(chunk):
        import re

        found = [re.match(r"^(\S+) is (\w+)\.?$", r) for r in chunk.split("\n")]
        return json.dumps([{"host": m[1], "status": m[2]} for m in found if m], separators=(",", ":"))

    done = Engine(STATUS, config).attempt(from_text(spark, text), Request(SCHEMA, max_tokens=max_tokens))
    want, items = plain_attempts("\n".join(r for r in text.split("\n") if r), extract, max_tokens, config.context)
    assert [(r["depth"], r["text"], r["outcome"]) for r in done.attempts.orderBy("index").collect()] == want
    assert values(done) == items
    assert (done.error is None) == (want[-1][2] != "failed")


def test_failures_come_in_input_order(spark):
    answers = spark.createDataFrame([("a", "[1]"), ("b", "[1"), ("c", "{}"), ("d", "[]")], "text string, raw string")
    engine = Engine(ReplayExtractor(answers))
    request = Request('{"type":"array","items":{"type":"number"}}')
    assert values(engine.extract(from_text(spark, "a", "d"), request)) == [1]
    for texts, error in (
        (("a", "b", "c"), "chunk 2: produced invalid JSON"), (("a", "c", "b"), "chunk 2: produced a non-array result"), (("unknown",), "chunk 1: generation produced no output"),
    ):
        done = engine.attempt(from_text(spark, *texts), request)
        assert done.error == error and values(done) == ([1] if texts[0] == "a" else [])
        with pytest.raises(ExtractionError):
            done.raise_for_error()
    with pytest.raises(ExtractionError, match="0: type"):
        engine.extract(from_text(spark, "a"), Request('{"type":"array","items":{"type":"string"}}'))


def test_constraints_hold_for_each_chunk_and_for_all(spark):
    answers = spark.createDataFrame([("a", "[1,2]"), ("b", "[2.0]")], "text string, raw string")
    engine = Engine(ReplayExtractor(answers))
    run = lambda schema: engine.attempt(from_text(spark, "a", "b"), Request(json.dumps({"type": "array", **schema})))
    assert run({"maxItems": 3}).error is None and run({"minItems": 1}).error is None
    assert run({"maxItems": 2}).error == "schema validation: (root): maxItems"
    assert run({"uniqueItems": True}).error == "schema validation: (root): uniqueItems"
    assert run({"minItems": 2}).error == "chunk 2: schema validation: (root): minItems"


def test_no_input_wrong_requests_and_closing(spark):
    engine = Engine(STATUS)
    for texts in (("",), (" \n\t", " ")):
        for schema in (SCHEMA, Request().schema):
            with pytest.raises(NoInput):
                engine.extract(from_text(spark, *texts), Request(schema))
    with pytest.raises(ValueError, match="context is too small"):
        engine.extract(from_text(spark, "x"), Request(SCHEMA, max_tokens=9000))
    with pytest.raises(ValueError, match="invalid schema"):
        engine.extract(from_text(spark, ""), Request("{"))
    with pytest.raises(ValueError, match="delimiter"):
        engine.extract(from_text(spark, "x"), Request(SCHEMA, delimiter=""))
    engine.close()
    engine.close()
    with pytest.raises(ExtractionError, match="closed"):
        engine.extract(from_text(spark, "x"), Request(SCHEMA))


def test_object_extraction(spark):
    rule = RuleExtractor(r"(?s)Incident (?<id>\S+) .*There are (?<n>\d+) failed", {"id": 1, "n": 2}, {"n": "long"})
    request = Request('{"type":"object","properties":{"id":{"type":"string"},"n":{"type":"integer"}},"required":["id","n"],"additionalProperties":false}')
    done = Engine(rule).extract(from_text(spark, "Incident INC-42 is on.", "There are 3 failed jobs."), request)
    assert values(done) == [{"id": "INC-42", "n": 3}] and done.metrics().first()["chunks_processed"] == 1
    assert Engine(rule).attempt(from_text(spark, "nothing"), request).error == "generation produced no output"
    many = spark.createDataFrame([(1, "Incident A x There are 1 failed"), (2, "none"), (3, " "), (4, None)], "source_index int, content string")
    got = {r["source_index"]: (r["v"], r["error"]) for r in extract_groups(many, rule, request).select("source_index", F.to_json("value").alias("v"), "error").collect()}
    assert got == {1: ('{"id":"A","n":1}', None), 2: (None, "generation produced no output")}


def test_model_extractor(spark):
    class Answer:
        def __init__(self, text):
            self.raw, self.prompt_tokens, self.generated_tokens, self.hit_limit, self.failure = text, 7, 5, False, None

    def load():
        return lambda prompt, most: Answer(json.dumps([prompt.rsplit("\n", 1)[-1], most]))

    done = Engine(ModelExtractor(load)).extract(from_text(spark, "one", "two"), Request('{"type":"array"}', max_tokens=9))
    assert values(done) == ["one", 9, "two", 9] and done.metrics().first()["generated_tokens"] == 10


def test_json_records_and_typed_columns(spark):
    schema = '{"type":"array","items":{"type":"object","properties":{"k":{"type":"integer"},"t":{"type":"string"},"m":{"type":"array","items":{"type":"number"}}},"additionalProperties":false}}'
    done = Engine(JsonExtractor()).extract(from_text(spark, '{"k":1,"t":"a"}\n{"k":2.0,"m":[1,2.5]}'), Request(schema))
    rows = typed(done.items, "value", prepare(schema).item).orderBy(*ORDER).select("k", "t", "m").collect()
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, None, [1.0, 2.5])]
    assert Engine(JsonExtractor()).attempt(from_text(spark, '{"k":1}\nx'), Request(schema)).error == "chunk 1: produced invalid JSON"
    assert values(Engine(JsonExtractor(strict=False)).extract(from_text(spark, '{"k":1}\nx'), Request(schema))) == [{"k": 1}]
    table = spark.createDataFrame([(1, "h is up"), (2, "no")], "i int, t string")
    assert [tuple(r) for r in rule_table(table, "t", STATUS).collect()] == [(1, "h is up", "h", "up")]
    assert [r["item_pos"] for r in json_items(spark.createDataFrame([(1, "[5,6]"), (2, "x")], "i int, t string"), "t").collect()] == [0, 1]


def test_rule_plan_has_no_python(spark):
    df = rule_table(spark.createDataFrame([("h is up",)], "t string"), "t", STATUS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_array_writer():
    items = ['{"status":"up","host":"a"}', '{"host":"b","status":"down"}']
    for compact in (True, False):
        out = io.StringIO()
        w = ArrayWriter(out, compact)
        with pytest.raises(RuntimeError):
            w.write("1")
        w.start()
        for i in items:
            w.write(i)
        w.finish()
        assert json.loads(out.getvalue()) == [json.loads(i) for i in items] and ("\n  {" in out.getvalue()) is not compact
        for wrong in (w.start, w.finish):
            with pytest.raises(RuntimeError):
                wrong()
        out = io.StringIO()
        w = ArrayWriter(out, compact)
        w.start()
        w.finish()
        assert out.getvalue() == "[]\n"
    out = io.StringIO()
    write_document('{"name":"Alice","age":1}', out)
    assert out.getvalue() == '{\n  "age": 1,\n  "name": "Alice"\n}\n'


def test_sinks(spark, tmp_path):
    done = Engine(STATUS).extract(from_text(spark, "\n".join(lines(5)), "\n".join(lines(2))), Request(SCHEMA))
    out = io.StringIO()
    assert write_array(done.items, ORDER, out, True) == 7 and json.loads(out.getvalue()) == hosts(5) + hosts(2)
    documents = {r["source_index"]: json.loads(r["document"]) for r in array_documents(done.items, ["source_index"], ORDER[1:]).collect()}
    assert documents == {0: hosts(5), 1: hosts(2)}
    write_lines(done.items, str(tmp_path / "out"), ORDER)
    assert sorted(r["host"] for r in spark.read.json(str(tmp_path / "out")).collect()) == sorted(x["host"] for x in hosts(5) + hosts(2))


def test_files(spark, tmp_path):
    for name, text in (("b.txt", "b1\nb2"), ("a +%.txt", "a"), ("empty.txt", "")):
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in ("b.txt", "a +%.txt", "b.txt", "empty.txt")]
    got = [tuple(r) for r in from_files(spark, paths).orderBy("source_index").collect()]
    assert got[:3] == [(0, paths[0], "b1\nb2"), (1, paths[1], "a"), (2, paths[2], "b1\nb2")]
    assert whole(from_files(spark, paths[:2])).first()["content"] == "b1\nb2\na\n"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        from_files(spark, [str(tmp_path / "none")]).collect()
    big = tmp_path / "big.txt"
    big.write_text("||".join(f"r{i}" for i in range(2000)) + "||||")
    read = large_file(spark, str(big), "||")
    assert [r["record"] for r in read.orderBy("record_pos").collect()] == [f"r{i}" for i in range(2000)]
    assert from_column(read.limit(2), "record", "record").columns == ["source_index", "source_name", "content"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_text("\n".join(lines(i + 1)))
    seen = []
    engine = Engine(STATUS)
    start = lambda: extract_stream(file_stream(spark, str(tmp_path / "in"), 2), engine, Request(SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp"), lambda n, e: seen.append(n))
    q = start()
    q.processAllAvailable()
    q.stop()
    (tmp_path / "in" / "f3.txt").write_text("late is up")
    q = start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.json(str(tmp_path / "out"))
    rows = got.orderBy("source_name", "chunk_in_source", "path", "item_pos").collect()
    assert [json.loads(r["value"])["host"] for r in rows] == ["h0", "h0", "h1", "h0", "h1", "h2", "late"] and len(seen) == 3


def run(spark, *args, text=""):
    out, err = io.StringIO(), io.StringIO()
    code = cli.run(list(args), io.StringIO(text), out, err, spark)
    return code, out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path):
    rule = r"rule:^(?<host>\S+) is (?<status>\w+)$"
    code, out, _ = run(spark, "--extractor", rule, "--fields", "host,status", text="\n".join(lines(3)))
    assert code == 0 and json.loads(out) == hosts(3) and out.startswith("[\n  {")
    code, out, err = run(spark, "--extractor", rule, "--fields", "host,status", "--compact", "--verbose", "--delimiter", "||", text="||".join(lines(2)))
    assert code == 0 and json.loads(out) == hosts(2) and "tokens_per_second" in err
    (tmp_path / "x").write_text(lines(1)[0])
    code, out, _ = run(spark, "--extractor", rule, "--fields", "host,status", str(tmp_path / "x"), str(tmp_path / "x"))
    assert code == 0 and json.loads(out) == hosts(1) * 2
    assert run(spark, "--fields", "a", text=" \n")[::2] == (1, "No input\n") and run(spark, "--fields", "a", text="")[1] == ""
    assert run(spark, "--fields", "", text="x")[0] == 1 and run(spark, "--delimiter", "\\x", text="x")[0] == 1
    code, out, err = run(spark, "--fields", "a", "--atomic", text='{"a":1}')
    assert code == 1 and out == "" and "type" in err
    code, out, _ = run(spark, text='{"content_type":"t","summary":"s","attributes":{"a":1},"warnings":[]}')
    assert code == 0 and json.loads(out)["attributes"] == {"a": 1}
    assert run(spark, "--version")[1].startswith("textloom ") and json.loads(run(spark, "--report")[1])["parallelism"] > 0


def test_artifacts(spark, tmp_path):
    import hashlib

    data = b"weights" * 1000
    (tmp_path / "src").write_bytes(data)
    a = Artifact("w.bin", len(data), hashlib.sha256(data).hexdigest())
    place = install(tmp_path / "src", tmp_path / "cache", a)
    assert verify(place, a) and install(tmp_path / "gone", tmp_path / "cache", a) == place
    place.write_bytes(b"broken")
    assert not verify(place, a) and verify(install(tmp_path / "src", tmp_path / "cache", a), a)
    with pytest.raises(ValueError):
        install(tmp_path / "src", tmp_path / "other", Artifact("w.bin", len(data), "0" * 64))
    assert sorted(x.name for x in (tmp_path / "other").iterdir()) == []
    assert checksums(spark, str(tmp_path / "cache")).first()["sha256"] == a.sha256


def test_relative_paths_folders_and_mixed_lists(spark, tmp_path):
    import os

    folder = os.path.relpath(tmp_path)
    (tmp_path / "access.log").write_text("\n".join(lines(3)))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "b.txt").write_text("b")
    (tmp_path / "more" / "a.txt").write_text("a")
    (tmp_path / "none").mkdir()
    mixed = [f"{folder}/access.log", str(tmp_path / "access.log"), f"file://{tmp_path}/more", f"{folder}/more/b.txt"]
    got = [(r["source_index"], r["content"]) for r in from_files(spark, mixed).orderBy("source_index").collect()]
    log = "\n".join(lines(3))
    assert got == [(0, log), (1, log), (2, "a"), (3, "b"), (4, "b")]
    with pytest.raises(FileNotFoundError):
        from_files(spark, [f"{folder}/none"])
    out = io.StringIO()
    assert cli.run(["--extractor", r"rule:^(?<host>\S+) is (?<status>\w+)", "--fields", "host,status", f"{folder}/access.log"], io.StringIO(), out, io.StringIO(), spark) == 0
    assert json.loads(out.getvalue()) == hosts(3)


@pytest.mark.parametrize("max_tokens", [7, 10, 11, 12, 16])
def test_outputs_cut_inside_a_character_are_tried_again(spark, max_tokens):
    text = "\n".join(["é😀ü is on", "日本語 is off", "ab😀 is up", "ñññññ is no"])
    done = Engine(STATUS, Config(context=700)).attempt(from_text(spark, text), Request(SCHEMA, max_tokens=max_tokens))
    left = iter(tuple(r.split(" is ")) for r in text.split("\n"))
    kept = [(v["host"], v["status"]) for v in values(done)]
    # a record whose output doesn't fit by itself is cut until nothing of it matches
    assert all(k in left for k in kept) and done.error is None
    assert len(kept) == 4 or max_tokens < 16


def test_first_bytes(spark):
    text = "aé日😀z"
    df = spark.createDataFrame([(text,)], "t string")
    for n in range(1, len(text.encode()) + 2):
        assert df.select(first_bytes(F.col("t"), n)).first()[0] == text.encode()[:n].decode("utf-8", "ignore")


def test_a_model_is_told_the_shape(spark):
    class Answer:
        prompt_tokens, generated_tokens, hit_limit, failure = 1, 1, False, None

        def __init__(self, raw):
            self.raw = raw

    load = lambda: lambda prompt, most, schema=None: Answer(json.dumps([schema is not None]))
    for enforce in (True, False):
        assert values(Engine(ModelExtractor(load), Config(enforce_shape=enforce)).extract(from_text(spark, "x"), Request('{"type":"array"}'))) == [enforce]
