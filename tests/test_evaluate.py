"""Corpora: loading, running, scoring and reporting."""

import json
import sys

import pytest

from textloom.evaluate import engine_runner, engine_samples, metadata, report, run_samples, score_samples, subprocess_runner, write_report
from textloom.model import Config
from textloom.operators.schema import fields_schema
from textloom.plans.extractors import RuleExtractor
from textloom.sources import corpus
from textloom.sources.corpus import CorpusError, check_by_schema, load_corpus

STATUS = fields_schema("host,status")
INCIDENT = json.dumps({"type": "object", "properties": {"id": {"type": "string"}, "jobs": {"type": "integer"}}, "required": ["id", "jobs"], "additionalProperties": False})
#: id: (case fields, input, schema, expected); the manifest's order is not that of the names.
CASES = {
    "status": ({"identity_fields": ["host"]}, "db-01 is up.\ndb-02 is down.", STATUS, [{"host": "db-01", "status": "up"}, {"host": "db-02", "status": "down"}]),
    "pipe": ({"identity_fields": ["host"], "delimiter": "||"}, "c-1 is up||c-2 is down", STATUS, [{"host": "c-1", "status": "up"}, {"host": "c-2", "status": "down"}]),
    "repeated": ({"comparison": "positional"}, "w is up.\nw is up.", STATUS, [{"host": "w", "status": "up"}] * 2),
    "incident": ({"comparison": "positional", "tier": "capability"}, "INC-42 is 3", INCIDENT, {"id": "INC-42", "jobs": 3}),
}
RULE = RuleExtractor(r"^(?<host>\S+) is (?<status>\w+)\.?$", {"host": 1, "status": 2})


def write(root, cases=None, manifest=None, **changes):
    cases = cases or CASES
    (root / "cases").mkdir(parents=True)
    (root / "manifest.json").write_text(json.dumps({"version": 1, "model": "rule", "cases": list(cases), **(manifest or {})}))
    for name, (more, text, schema, expected) in cases.items():
        d = root / "cases" / name
        d.mkdir()
        case = {"id": name, "description": "d", "tier": "conformance", "tags": [], "delimiter": "\n", "identity_fields": [], "comparison": "ordered", "allow_additional_fields": False, "normalizers": {}, **more, **changes.get(name, {})}
        (d / "case.json").write_text(json.dumps(case))
        (d / ("input.bin" if name == "pipe" else "input.txt")).write_text(text)
        (d / "schema.json").write_text(schema)
        (d / "expected.json").write_text(json.dumps(expected))
    return str(root)


def test_manifest_order_and_fields(spark, tmp_path):
    cases = load_corpus(spark, write(tmp_path / "c")).orderBy("case_pos").collect()
    assert [r["case_id"] for r in cases] == list(CASES)
    assert cases[1]["delimiter"] == "||" and cases[1]["input"] == "c-1 is up||c-2 is down" and cases[0]["identity_fields"] == ["host"]


@pytest.mark.parametrize(
    "manifest,changes,problem",
    [
        ({"version": 0}, {}, "version"), ({"cases": []}, {}, "no cases"), ({"cases": ["status", "status"]}, {}, "more than once"), ({"cases": ["../x"]}, {}, "unsafe id"),
        ({"cases": ["none"]}, {}, "no input"), ({}, {"status": {"id": "other"}}, "differs"), ({}, {"status": {"description": ""}}, "required"),
        ({}, {"pipe": {"tier": "x"}}, "tier"), ({}, {"pipe": {"comparison": "x"}}, "comparison"),
    ],
)
def test_wrong_corpora(spark, tmp_path, manifest, changes, problem):
    with pytest.raises(CorpusError, match=problem):
        load_corpus(spark, write(tmp_path / "c", manifest=manifest, **changes))


def test_expected_results_must_fit_their_schema(spark, tmp_path):
    with pytest.raises(CorpusError, match="jobs: type"):
        load_corpus(spark, write(tmp_path / "c", {"incident": ({}, "x", INCIDENT, {"id": "a", "jobs": "3"})}))


def test_evaluation(spark, tmp_path):
    cases = load_corpus(spark, write(tmp_path / "c"))
    samples = run_samples(cases, engine_runner(spark, RULE), repetitions=2, warmups=1)
    done = score_samples(cases, samples)
    scores = {(r["case_id"], r["repetition"]): r for r in done.scores.collect()}
    assert len(scores) == 8
    assert all(r["valid"] and r["exact_match"] for (c, _), r in scores.items() if c != "incident")
    # the rule's fields aren't the incident's: the output fails its schema, so that nothing of it is compared
    assert all(not r["json_valid"] and not r["valid"] and "required" in r["failure"] for (c, _), r in scores.items() if c == "incident")
    summary = done.summary.first()
    assert summary["samples"] == 8 and summary["exact_matches"] == 6 and summary["record_recall"] == 1 and summary["record_recall_strict"] == 12 / 14
    document = json.loads(report(done, metadata(spark, "rule", Config())))
    assert document["summary"]["json_valid"] == 6 and len(document["samples"]) == 8 and document["samples"][0]["case_id"] == "incident"
    assert document["samples"][0]["differences"][0]["kind"] == "invalid_json"
    for wrong in ({"repetitions": 0}, {"warmups": -1}):
        with pytest.raises(ValueError):
            run_samples(cases, engine_runner(spark, RULE), **wrong)


def test_one_plan_gives_what_runs_one_by_one_give(spark, tmp_path):
    more = {
        **CASES,
        "few": ({}, "a is up.\nb is up.", json.dumps({**json.loads(STATUS), "minItems": 3}), [{"host": "a", "status": "up"}] * 3),
        "many": ({}, "a is up.\nb is up.", json.dumps({**json.loads(STATUS), "maxItems": 5}), []),
        "nothing": ({}, "no rule fits", STATUS, []),
        "blank": ({}, " \n ", STATUS, []),
    }
    cases = load_corpus(spark, write(tmp_path / "c", more))
    rows = lambda df: sorted(map(tuple, df.select("case_id", "repetition", "actual", "failure").collect()))
    # room for one record a chunk: halves and attempts are numbered within each case
    for config, most in ((Config(), 2048), (Config(context=600 + 24 + 8), 24)):
        one = rows(engine_samples(cases, RULE, config, most))
        assert one == rows(run_samples(cases, engine_runner(spark, RULE, config, most)))
    samples = engine_samples(cases, RULE, repetitions=2)
    assert rows(samples) == sorted((c, n, a, f) for c, _, a, f in rows(engine_samples(cases, RULE)) for n in (1, 2))
    done = score_samples(cases, samples)
    write_report(done, {"extractor": "rule"}, f"file://{tmp_path}/r")
    about = json.loads(spark.read.text(f"file://{tmp_path}/r/summary").first()[0])
    assert about["metadata"] == {"extractor": "rule"} and about["summary"] == json.loads(report(done, {}))["summary"]
    assert sorted(r["case_id"] for r in spark.read.json(f"file://{tmp_path}/r/samples").collect()) == sorted([*more] * 2)
    assert engine_samples(cases.limit(0), RULE).count() == 0
    with pytest.raises(ValueError):
        engine_samples(cases, RULE, repetitions=0)


def test_subprocess_output_is_scored_even_if_it_fails(spark, tmp_path):
    cases = load_corpus(spark, write(tmp_path / "c", {"status": CASES["status"]}))
    script = "import json,sys; print(json.dumps([{'host':l.split()[0],'status':l.split()[2][:-1]} for l in sys.stdin.read().splitlines()])); sys.exit(3)"
    done = score_samples(cases, run_samples(cases, subprocess_runner([sys.executable, "-c", script])))
    r = done.scores.first()
    assert r["exact_match"] and not r["valid"] and r["failure"].startswith("exit 3")


def test_any_number_of_schemas(spark, monkeypatch):
    monkeypatch.setattr(corpus, "SCHEMAS_AT_ONCE", 3)
    rows = [(f"c{i}", json.dumps({"type": "array", "maxItems": i % 8}), "[1,2,3]") for i in range(16)] + [("none", None, "1"), ("broken", '{"type":"array"}', "{")]
    checked = check_by_schema(spark.createDataFrame(rows, "case_id string, schema string, t string"), "t")
    got = {r["case_id"]: r["error"] for r in checked.collect()}
    want = {f"c{i}": "schema validation: (root): maxItems" if i % 8 < 3 else None for i in range(16)}
    assert got == {**want, "none": None, "broken": "invalid JSON"}
