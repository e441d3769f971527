"""The registered queries of the engine's own operators, each with its SQL twin where SQL can express it.

Every query runs over whole tables. In the SQL, tables are those of the test data.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.json import last_key_wins, strict_json
from textloom.functions.storage import materialize, spread
from textloom.functions.text import human_size, n_bytes, ratio, split_literal, trim_space
from textloom.model import Config, Request, byte_budget
from textloom.operators.chunk import chunk_texts, halves, pack, records
from textloom.operators.metrics import quality_summary
from textloom.operators.order import numbered
from textloom.operators.schema import fields_schema, prepare
from textloom.operators.score import COUNTS, compared, differences, score, scores
from textloom.operators.validate import array_violations, validate
from textloom.plans.engine import Engine, extract_each, extract_groups
from textloom.plans.extractors import JsonExtractor, RuleExtractor, rule_table, typed
from textloom.sinks.json import array_documents
from textloom.sources.text import from_column, whole

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BUDGET = byte_budget(8192, 2048)
SMALL_BUDGET = 1000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id", content: str = "text") -> DataFrame:
    return from_column(table(spark, sf_dir, name), key, content)


# --- sources and records -------------------------------------------------------------------------


RECORDS_SQL = """
    SELECT doc_id, CAST(pos - 1 AS INT) AS record_pos, record, strlen(record) AS n_bytes
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS record,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
    WHERE record <> ''"""


@query(RECORDS_SQL)
def split_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of every document."""
    return records(sources(spark, sf_dir), "\n").withColumnRenamed("source_index", "doc_id")


@query("""
    SELECT conv_id, turn, role, strlen(text) AS n_bytes, len(string_split(text, '. ')) AS n_parts,
           coalesce(list_max(list_transform(string_split(text, '. '), lambda x: strlen(x))), 0) AS longest
    FROM conversations""")
def record_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S4, sizes in bytes: a delimiter of two characters, one of them special in expressions."""
    parts = split_literal(F.col("text"), ". ")
    longest = F.array_max(F.transform(parts, lambda p: n_bytes(p)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n_bytes(F.col("text")).alias("n_bytes"), F.size(parts).cast("long").alias("n_parts"), F.coalesce(longest, F.lit(0)).alias("longest"))


@query("""
    SELECT conv_id, sha256(string_agg(text || chr(10), '' ORDER BY turn, role, text)) AS content_sha256,
           CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes
    FROM conversations GROUP BY conv_id""")
def whole_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of a request, in order, a line feed after each - here the turns of each conversation."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["text"], F.lit("\n"))), "")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(text.alias("content")).select("conv_id", F.sha2("content", 256).alias("content_sha256"), n_bytes(F.col("content")).alias("n_bytes"))


@query("""
    SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS content_sha256 FROM region""")
def whole_input_of_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 for one request over a small dimension."""
    return whole(sources(spark, sf_dir, "region", "r_regionkey", "r_name")).select(F.sha2("content", 256).alias("content_sha256"))


# --- chunks --------------------------------------------------------------------------------------


def chunks_sql(budget: int) -> str:
    """Next-fit as a recursion over the records of each document."""
    space = r"[\s\x{85}\p{Z}\v]+"
    return f"""
        WITH RECURSIVE recs AS (
            SELECT doc_id, record, strlen(record) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY record_pos) AS rn
            FROM ({RECORDS_SQL})),
        fold AS (
            SELECT doc_id, rn, record, n, n AS cur, 0 AS cid FROM recs WHERE rn = 1
            UNION ALL
            SELECT r.doc_id, r.rn, r.record, r.n, CASE WHEN f.cur + r.n > {budget} THEN r.n ELSE f.cur + r.n END,
                   CASE WHEN f.cur + r.n > {budget} THEN f.cid + 1 ELSE f.cid END
            FROM fold f JOIN recs r ON r.doc_id = f.doc_id AND r.rn = f.rn + 1),
        joined AS (
            SELECT doc_id, cid, regexp_replace(string_agg(record, chr(10) ORDER BY rn), '^{space}|{space}$', '', 'g') AS text,
                   CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS n_records
            FROM fold GROUP BY doc_id, cid)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cid) - 1 AS INT) AS chunk_in_source,
               sha256(text) AS text_sha256, n_bytes, n_records
        FROM joined WHERE text <> ''"""


def hashed(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.col("source_index").alias("doc_id"), "chunk_in_source", F.sha2("text", 256).alias("text_sha256"), "n_bytes", "n_records")


@query(chunks_sql(BUDGET))
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the default budget, without any shuffle."""
    return hashed(chunk_texts(sources(spark, sf_dir), "\n", BUDGET))


@query(chunks_sql(SMALL_BUDGET))
def pack_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 through the packer for sources of any size."""
    return hashed(pack(records(sources(spark, sf_dir), "\n"), "\n", SMALL_BUDGET))


def one_source_sql(budget: int) -> str:
    """Next-fit of all records as one source: from each chunk's start to the first record that it can't hold."""
    space = r"[\s\x{85}\p{Z}\v]+"
    return f"""
        WITH RECURSIVE recs AS MATERIALIZED (
            SELECT record, n, CAST(sum(n) OVER (ORDER BY doc_id, record_pos) - n AS BIGINT) AS start_byte
            FROM (SELECT doc_id, record_pos, record, strlen(record) AS n FROM ({RECORDS_SQL}))),
        starts AS (
            SELECT min(start_byte) AS start_byte FROM recs
            UNION ALL
            SELECT start_byte FROM (SELECT (SELECT min(r.start_byte) FROM recs r WHERE r.start_byte > s.start_byte AND r.start_byte + r.n > s.start_byte + {budget}) AS start_byte FROM starts s) WHERE start_byte IS NOT NULL),
        placed AS (SELECT r.*, s.start_byte AS start FROM recs r ASOF JOIN starts s ON r.start_byte >= s.start_byte),
        joined AS (
            SELECT start, regexp_replace(string_agg(record, chr(10) ORDER BY start_byte), '^{space}|{space}$', '', 'g') AS text,
                   CAST(sum(n) AS BIGINT) AS n_bytes, count(*) AS n_records
            FROM placed GROUP BY start)
        SELECT CAST(row_number() OVER (ORDER BY start) - 1 AS INT) AS chunk_in_source, sha256(text) AS text_sha256, n_bytes, n_records
        FROM joined WHERE text <> ''"""


@query(one_source_sql(SMALL_BUDGET))
def pack_one_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents after one another as one source, whose chunks are found in parallel."""
    recs = numbered(records(sources(spark, sf_dir), "\n"), ["source_index", "record_pos"], "at", 0)
    recs = recs.select(F.lit(0).cast("long").alias("source_index"), F.col("at").alias("record_pos"), "record", "n_bytes")
    return hashed(pack(recs, "\n", SMALL_BUDGET)).drop("doc_id")


@query("""
    WITH p AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
    h AS (SELECT doc_id,
        CASE WHEN len(parts) > 1 THEN array_to_string(parts[1:len(parts) // 2], chr(10))
             WHEN length(text) >= 2 THEN text[1:length(text) // 2] END AS l,
        CASE WHEN len(parts) > 1 THEN array_to_string(parts[len(parts) // 2 + 1:], chr(10))
             WHEN length(text) >= 2 THEN text[length(text) // 2 + 1:] END AS r
      FROM p)
    SELECT doc_id, sha256(l) AS left_sha256, sha256(r) AS right_sha256, strlen(l) AS left_bytes, strlen(r) AS right_bytes FROM h""")
def split_chunk_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: every document cut in two, at a record or else at a character."""
    h = table(spark, sf_dir, "documents").select("doc_id", halves(F.col("text"), "\n").alias("h"))
    return h.select("doc_id", F.sha2("h.left", 256).alias("left_sha256"), F.sha2("h.right", 256).alias("right_sha256"), n_bytes(F.col("h.left")).alias("left_bytes"), n_bytes(F.col("h.right")).alias("right_bytes"))


# --- rule and JSON extraction --------------------------------------------------------------------

NUMBERED = RuleExtractor(r"^(?<kind>[A-Za-z]+)#(?<number>[0-9]+)$", {"kind": 1, "number": 2}, {"number": "long"})


@query("""
    SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 1) AS kind,
           CAST(regexp_extract(c_name, '^([A-Za-z]+)#([0-9]+)$', 2) AS BIGINT) AS number, c_mktsegment
    FROM customer WHERE regexp_matches(c_name, '^([A-Za-z]+)#([0-9]+)$')""")
def rule_extract_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule compiled to expressions over a column of records."""
    return rule_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_name", NUMBERED).drop("c_name")


@query("""
    SELECT p_partkey, split_part(p_name, ' ', 1) AS first_word, split_part(p_name, ' ', 2) AS second_word,
           CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS maker
    FROM part WHERE regexp_matches(p_name, '^(\\S+) (\\S+)')""")
def extract_part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: fields of a closed schema of strings."""
    rule = RuleExtractor(r"^(?<first>\S+) (?<second>\S+)", {"first_word": 1, "second_word": 2})
    rows = rule_table(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_name", rule)
    return rows.select("p_partkey", "first_word", "second_word", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("maker"))


PROPS = json.dumps({"type": "object", "properties": {"k": {"type": "integer", "minimum": 0}}, "required": ["k"], "additionalProperties": False})


@query("""
    SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0""")
def extract_event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V3 and the typed projection: strict parsing and validation of every event's JSON, in the JVM."""
    last_key_wins(spark)
    schema = prepare(PROPS)
    good = validate(table(spark, sf_dir, "events"), "props", schema.schema).filter("error is null")
    return typed(good.select("event_id", "event_type", "value"), "value", schema.item)


@query("""
    SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
           regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) AS path
    FROM pages""")
def extract_page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, p: F.regexp_extract(c, p, 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", part("html", '<html lang="([^"]*)"').alias("lang"), part("html", "<title>([^<]*)</title>").alias("title"),
        part("url", "^[a-z]+://([^/]+)").alias("host"), part("url", "^[a-z]+://[^/]+([^?#]*)").alias("path"),
    )


EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z]"


@query(f"""
    SELECT doc_id, CAST(i - 1 AS INT) AS item_pos, email
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS email,
                 generate_subscripts(regexp_extract_all(text, '{EMAIL}'), 1) AS i FROM documents)""")
def extract_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many items of one record, in order and with repeats."""
    found = F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(found).alias("item_pos", "email"))


PROPER = RuleExtractor("^(?<first>[A-Z][a-z]+) (?<second>[a-z]+)", {"first": 1, "second": 2})


@query(f"""
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(first || ' ' || second, ',' ORDER BY record_pos)) AS items_sha256
    FROM (SELECT doc_id, record_pos, regexp_extract(record, '^([A-Z][a-z]+) ([a-z]+)', 1) AS first, regexp_extract(record, '^([A-Z][a-z]+) ([a-z]+)', 2) AS second
          FROM ({RECORDS_SQL}) WHERE regexp_matches(record, '^([A-Z][a-z]+) ([a-z]+)'))
    GROUP BY doc_id""")
def engine_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through chunks, extraction, validation and ordered items."""
    done = Engine(PROPER).extract(sources(spark, sf_dir), Request(fields_schema("first,second")))
    items = typed(done.items, "value", done.prepared.item)
    place = F.struct("chunk_in_source", "path", "item_pos", F.concat_ws(" ", "first", "second").alias("t"))
    texts = F.transform(F.array_sort(F.collect_list(place)), lambda s: s["t"])
    return items.groupBy(F.col("source_index").alias("doc_id")).agg(F.count("*").alias("n_items"), F.sha2(F.array_join(texts, ","), 256).alias("items_sha256"))


@query(r"""
    SELECT doc_id, sha256('[' || coalesce(string_agg('{"first":"' || regexp_extract(record, '^([A-Z][a-z]+) ([a-z]+)', 1) || '","second":"' || regexp_extract(record, '^([A-Z][a-z]+) ([a-z]+)', 2) || '"}', ','
                                                  ORDER BY record_pos) FILTER (regexp_matches(record, '^([A-Z][a-z]+) ([a-z]+)')), '') || ']') AS actual_sha256,
           CAST(NULL AS VARCHAR) AS failure
    FROM (""" + RECORDS_SQL + r""") WHERE doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\s\x{85}\p{Z}\v]')) GROUP BY doc_id""")
def extract_each_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document an input of its own, all in one plan."""
    done = extract_each(sources(spark, sf_dir), PROPER, Request(fields_schema("first,second")))
    return done.select(F.col("source_index").alias("doc_id"), F.sha2("actual", 256).alias("actual_sha256"), "failure")


def _crowded(spark: SparkSession, sf_dir: str):
    """Every customer's name in one source per nation, with so little room that chunks must be split."""
    names = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("source_index"))
    names = names.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda s: s["c_name"]), "\n").alias("content"))
    # 72 bytes of input a chunk, so up to 4 names; outputs of more than one are over the limit
    rule = RuleExtractor(NUMBERED.pattern, {"kind": 1, "number": 2})
    return Engine(rule, Config(context=600 + 24 + 20)).extract(names, Request(fields_schema("kind,number"), max_tokens=20))


@query("""
    SELECT CAST(sum(n) AS BIGINT) AS records_produced, CAST(sum(2 * n - 1) FILTER (n > 0) AS BIGINT) AS from_splits,
           CAST(sum(2 * n - 2) AS BIGINT) AS chunks_retried, CAST(sum(bytes) AS BIGINT) AS leaf_input_bytes
    FROM (SELECT c_nationkey, rn // 4 AS c, count(*) AS n, sum(strlen(c_name)) AS bytes
          FROM (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS rn FROM customer)
          GROUP BY ALL)""")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk of n records, each fitting alone only, takes 2n - 1 attempts."""
    return _crowded(spark, sf_dir).metrics().select("records_produced", F.col("chunks_processed").alias("from_splits"), "chunks_retried", "leaf_input_bytes")


@query("""
    WITH c AS (SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 4 AS chunk, c_custkey FROM customer),
    n AS (SELECT c_nationkey, chunk, count(*) AS n, min(c_custkey) AS first FROM c GROUP BY ALL)
    SELECT CAST(c_nationkey AS INT) AS source_index, CAST(chunk AS INT) AS chunk_in_source,
           CAST(1 + coalesce(sum(2 * n - 1) OVER (ORDER BY c_nationkey, chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_index,
           CAST(2 * n - 1 AS BIGINT) AS n_attempts
    FROM n""")
def attempt_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts numbered through, in the order of a single worker."""
    attempts = _crowded(spark, sf_dir).attempts
    return attempts.groupBy("source_index", "chunk_in_source").agg(F.min("index").alias("first_index"), F.count("*").alias("n_attempts"))


@query("""
    SELECT CAST(c_nationkey AS INT) AS source_index, string_agg(c_name, ',' ORDER BY c_custkey) AS names FROM customer GROUP BY c_nationkey""")
def retry_split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splitting loses, repeats and reorders nothing."""
    done = _crowded(spark, sf_dir)
    items = typed(done.items, "value", done.prepared.item)
    place = F.struct("chunk_in_source", "path", "item_pos", F.concat_ws("#", "kind", "number").alias("t"))
    return items.groupBy("source_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda s: s["t"]), ",").alias("names"))


@query("""
    SELECT conv_id, length(t) AS n_chars, first
    FROM (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id),
         LATERAL (SELECT regexp_extract(t, '^\\s*(\\S+)', 1) AS first) WHERE regexp_matches(t, '^\\s*\\S+')""")
def default_object_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object for each conversation, as an input of its own."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["text"], F.lit("\n"))), "")
    groups = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("source_index")).agg(text.alias("content"))
    schema = json.dumps({"type": "object", "properties": {"first": {"type": "string", "minLength": 1}}, "required": ["first"]})
    config = Config(context=1 << 30)
    groups = materialize(groups)
    done = extract_groups(groups, RuleExtractor(r"^\s*(?<first>\S+)", {"first": 1}), Request(schema), config).filter("error is null")
    first = done.select(F.col("source_index").alias("conv_id"), F.variant_get("value", "$.first", "string").alias("first"))
    sizes = groups.select(F.col("source_index").alias("conv_id"), F.char_length("content").cast("long").alias("n_chars"))
    return first.join(sizes, "conv_id").select("conv_id", "n_chars", "first")


# --- validation ----------------------------------------------------------------------------------


def _events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a JSON object, some broken by rules of the id."""
    last_key_wins(spark)
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 7 == 0, F.lit("other")).otherwise(F.col("event_type"))
    number = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('"'), F.col("user_id"), F.lit('"'))).otherwise(F.col("user_id").cast("string"))
    member = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"user":'), number))
    end = F.when(F.col("event_id") % 11 == 0, F.lit("} trailing")).otherwise(F.lit("}"))
    return e.select("event_id", "event_type", F.concat(F.lit('{"type":"'), kind, F.lit('"'), member, end).alias("j"))


def _kinds(spark: SparkSession, sf_dir: str) -> list[str]:
    """The few values of event_type."""
    return sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())


def _verdict(sql: str) -> str:
    return f"SELECT event_id, {sql} AS error FROM events"


@query(_verdict("CASE WHEN event_id % 11 = 0 THEN 'invalid JSON' WHEN event_id % 3 = 0 THEN 'schema validation: (root): required' END"))
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: a member that must be there."""
    return validate(_events_json(spark, sf_dir), "j", {"required": ["user"]}).select("event_id", "error")


@query(_verdict("CASE WHEN event_id % 11 = 0 THEN 'invalid JSON' WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN 'schema validation: user: type' END"))
def validate_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: a string that looks like a number is none."""
    return validate(_events_json(spark, sf_dir), "j", {"properties": {"user": {"type": "integer"}}}).select("event_id", "error")


@query(_verdict("CASE WHEN event_id % 11 = 0 THEN 'invalid JSON' WHEN event_id % 7 = 0 THEN 'schema validation: type: enum' END"))
def validate_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: one of a list."""
    return validate(_events_json(spark, sf_dir), "j", {"properties": {"type": {"enum": _kinds(spark, sf_dir)}}}).select("event_id", "error")


@query("""
    SELECT event_id, event_id % 11 <> 0 AS valid, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 'other' ELSE event_type END END AS type
    FROM events""")
def strict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: one JSON value and nothing after it."""
    v = strict_json(F.col("j"))
    return _events_json(spark, sf_dir).select("event_id", v.isNotNull().alias("valid"), F.try_variant_get(v, "$.type", "string").alias("type"))


@query("""
    SELECT unnest(list_filter([CASE WHEN count(*) > 10 THEN 'maxItems' END, CASE WHEN count(DISTINCT event_type) < count(*) THEN 'uniqueItems' END], lambda x: x IS NOT NULL)) AS keyword
    FROM events""")
def global_array_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: what all items together break."""
    return array_violations(table(spark, sf_dir, "events"), {"minItems": 1, "maxItems": 10, "uniqueItems": True}, "event_type")


# --- scoring -------------------------------------------------------------------------------------

#: The orders of each customer as records; the perturbed side drops, changes, adds and reorders by rules of the key.
DROPPED, CHANGED, ADDED = 17, 13, 19


def _order_samples(spark: SparkSession, sf_dir: str, identity: bool) -> DataFrame:
    last_key_wins(spark)
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    # a customer's orders by key: a handful, gathered once
    sides = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("o_orderstatus").alias("s")))).alias("_orders"))
    record = lambda k, status: F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"status":"'), status, F.lit('"}'))
    status = lambda o: F.when(o["k"] % CHANGED == 0, F.lit("?")).otherwise(o["s"])
    every = F.transform("_orders", lambda o: record(o["k"], o["s"]))
    kept = F.transform(F.filter("_orders", lambda o: o["k"] % DROPPED != 0), lambda o: record(o["k"], status(o)))
    added = F.transform(F.filter("_orders", lambda o: o["k"] % ADDED == 0), lambda o: record(-o["k"], status(o)))
    text = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    ids = F.array(F.lit("id")) if identity else F.array().cast("array<string>")
    return sides.select(
        F.col("o_custkey").cast("string").alias("case_id"), F.lit(1).alias("repetition"), F.lit("conformance").alias("tier"), ids.alias("identity_fields"),
        F.lit(False).alias("allow_additional_fields"), text(every).alias("expected"), text(F.concat(kept, added)).alias("actual"), F.lit(True).alias("schema_valid"),
    )


SIDES_SQL = f"""
    e AS (SELECT o_custkey, o_orderkey AS id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
    a0 AS (
        SELECT o_custkey, o_orderkey AS id, CASE WHEN o_orderkey % {CHANGED} = 0 THEN '?' ELSE o_orderstatus END AS status, 0 AS part, o_orderkey AS k
        FROM orders WHERE o_orderkey % {DROPPED} <> 0
        UNION ALL
        SELECT o_custkey, -o_orderkey, CASE WHEN o_orderkey % {CHANGED} = 0 THEN '?' ELSE o_orderstatus END, 1, o_orderkey
        FROM orders WHERE o_orderkey % {ADDED} = 0),
    a AS (SELECT o_custkey, id, status, row_number() OVER (PARTITION BY o_custkey ORDER BY part, k) AS pos FROM a0)"""


def scores_sql(on: str, order: str) -> str:
    return f"""
        WITH {SIDES_SQL},
        p AS (SELECT coalesce(e.o_custkey, a.o_custkey) AS c, e.id AS eid, a.id AS aid, e.pos AS ep, a.pos AS ap, e.status AS es, a.status AS st
              FROM e FULL OUTER JOIN a ON e.o_custkey = a.o_custkey AND {on}),
        s AS (SELECT c, count(eid) AS expected_records, count(aid) AS actual_records, count(*) FILTER (eid IS NOT NULL AND aid IS NOT NULL) AS matched_records,
                     count(*) FILTER (aid IS NULL) AS missing_records, count(*) FILTER (eid IS NULL) AS extra_records,
                     coalesce(list(eid ORDER BY ep) FILTER (eid IS NOT NULL) = list(aid ORDER BY ap) FILTER (aid IS NOT NULL), FALSE) AS same_order,
                     2 * count(*) FILTER (eid IS NOT NULL AND aid IS NOT NULL) AS expected_fields,
                     count(*) FILTER (eid IS NOT NULL AND aid IS NOT NULL AND eid <> aid) + count(*) FILTER (eid IS NOT NULL AND aid IS NOT NULL AND es <> st) AS incorrect_fields
              FROM p GROUP BY c),
        f AS (SELECT *, {order} AS order_correct FROM s)
        SELECT CAST(c AS VARCHAR) AS case_id, expected_records, actual_records, matched_records, missing_records, extra_records, expected_fields,
               expected_fields - incorrect_fields AS correct_fields, incorrect_fields, order_correct,
               order_correct AND missing_records + extra_records + incorrect_fields = 0 AS exact_match
        FROM f"""


BY_IDENTITY_SQL, BY_POSITION_SQL = scores_sql("e.id = a.id", "same_order"), scores_sql("e.pos = a.pos", "missing_records + extra_records + incorrect_fields = 0")
SCORED = ["case_id", "expected_records", "actual_records", "matched_records", "missing_records", "extra_records", "expected_fields", "correct_fields", "incorrect_fields", "order_correct", "exact_match"]


@query(BY_IDENTITY_SQL)
def identity_join_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3, Q6, Q8, Q10: records matched by identity, over every customer."""
    return scores(compared(_order_samples(spark, sf_dir, True))).select(*SCORED)


@query(BY_POSITION_SQL)
def positional_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: the same records matched by position."""
    return scores(compared(_order_samples(spark, sf_dir, False))).select(*SCORED)


def _differences(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return differences(compared(_order_samples(spark, sf_dir, True))).filter(F.col("kind") == kind).select("case_id", "path", "kind", "expected", "actual")

    return run


def _record_sql(alias: str) -> str:
    return f"""'{{"id":' || {alias}.id || ',"status":"' || {alias}.status || '"}}'"""


QUERIES["missing_records"] = _differences("missing_record")
ORACLES["missing_records"] = f"""
    WITH {SIDES_SQL} SELECT CAST(o_custkey AS VARCHAR) AS case_id, '$[[' || id || ']]' AS path, 'missing_record' AS kind, {_record_sql("e")} AS expected, '' AS actual
    FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = e.o_custkey AND a.id = e.id)"""
QUERIES["extra_records"] = _differences("extra_record")
ORACLES["extra_records"] = f"""
    WITH {SIDES_SQL} SELECT CAST(o_custkey AS VARCHAR) AS case_id, '$[[' || id || ']]' AS path, 'extra_record' AS kind, '' AS expected, {_record_sql("a")} AS actual
    FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE a.o_custkey = e.o_custkey AND a.id = e.id)"""
QUERIES["field_differences"] = _differences("value")
ORACLES["field_differences"] = f"""
    WITH {SIDES_SQL} SELECT CAST(e.o_custkey AS VARCHAR) AS case_id, '$[[' || e.id || ']].status' AS path, 'value' AS kind, '"' || e.status || '"' AS expected, '"' || a.status || '"' AS actual
    FROM e JOIN a ON e.o_custkey = a.o_custkey AND e.id = a.id WHERE e.status <> a.status"""


@query(f"""
    SELECT count(*) AS samples, count(*) FILTER (exact_match) AS exact_matches, count(*) FILTER (order_correct) AS order_correct,
           CAST(sum(matched_records) AS DOUBLE) / sum(expected_records) AS record_recall, CAST(sum(matched_records) AS DOUBLE) / sum(actual_records) AS record_precision,
           CAST(sum(correct_fields) AS DOUBLE) / sum(expected_fields) AS field_accuracy, CAST(count(*) FILTER (order_correct) AS DOUBLE) / count(*) AS order_correct_rate
    FROM ({BY_IDENTITY_SQL})""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: counts and micro-averaged ratios."""
    r = quality_summary(scores(compared(_order_samples(spark, sf_dir, True))))
    return r.select("samples", "exact_matches", "order_correct", "record_recall", "record_precision", "field_accuracy", "order_correct_rate")


@query("""
    SELECT o_orderstatus, CAST(count(*) FILTER (o_totalprice > 100000) AS DOUBLE) / count(*) AS high_share, 0.0::DOUBLE AS of_nothing FROM orders GROUP BY ALL""")
def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: a ratio of nothing is 0."""
    agg = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("h"), F.count("*").alias("n"))
    return agg.select("o_orderstatus", ratio(F.col("h"), F.col("n")).alias("high_share"), ratio(F.col("h"), F.lit(0)).alias("of_nothing"))


#: What each kind of sample gives, by p_partkey % 10: counts and flags of its score, and its differences.
CASES_SQL = """
    SELECT p_partkey, CASE p_partkey % 10
        WHEN 0 THEN [2, 2, 2, 0, 0, 4, 4, 0, 0, 0]  -- the same records by identity
        WHEN 1 THEN [0, 0, 0, 0, 0, 0, 0, 0, 0, 0]  -- broken JSON
        WHEN 2 THEN [0, 0, 0, 0, 0, 0, 0, 0, 0, 0]  -- an array against an object
        WHEN 3 THEN [1, 1, 1, 0, 0, 2, 2, 0, 0, 0]  -- the same object
        WHEN 4 THEN [1, 1, 1, 0, 0, 2, 1, 0, 1, 0]  -- an object without a member
        WHEN 5 THEN [2, 2, 2, 0, 0, 4, 4, 0, 0, 0]  -- an identity that repeats: by position
        WHEN 6 THEN [1, 1, 1, 0, 0, 2, 1, 1, 0, 0]  -- arrays within records compare as wholes
        WHEN 7 THEN [1, 1, 1, 0, 0, 2, 1, 1, 0, 1]  -- an object against a scalar, and a member too many
        WHEN 8 THEN [1, 1, 1, 0, 0, 4, 2, 1, 0, 0]  -- a difference below a member: both are incorrect
        ELSE [2, 2, 2, 0, 0, 4, 4, 0, 0, 0] END AS n,  -- the same records in another order
        CASE p_partkey % 10 WHEN 0 THEN [] WHEN 1 THEN ['invalid_json'] WHEN 2 THEN ['type'] WHEN 3 THEN [] WHEN 4 THEN ['missing_field'] WHEN 5 THEN ['identity']
            WHEN 6 THEN ['value'] WHEN 7 THEN ['type', 'unexpected_field'] WHEN 8 THEN ['value'] ELSE ['order'] END AS kinds,
        p_partkey % 10 IN (0, 3, 4, 6, 7, 8) AS order_correct
    FROM part"""


def _case_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for every part, of one of ten kinds."""
    # a few bytes a row, which Spark reads in few tasks, become much work
    p = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    k = F.col("p_partkey").cast("string")
    text = lambda form: F.replace(F.lit(form), F.lit("#"), k)
    forms = [
        ('[{"id":#,"t":"a"},{"id":#.5,"t":"b"}]', '[{"t":"a","id":#.0},{"id":#.5,"t":"b"}]', True),
        ('[{"id":#}]', '[{"id":#}', True),
        ('[{"id":#}]', '{"id":#}', True),
        ('{"id":#,"t":"a"}', '{"t":"a","id":#}', False),
        ('{"id":#,"t":"a"}', '{"id":#}', False),
        ('[{"id":#,"t":"a"},{"id":#,"t":"b"}]', '[{"id":#,"t":"a"},{"id":#,"t":"b"}]', True),
        ('[{"id":#,"v":[1,#]}]', '[{"id":#,"v":[#,1]}]', True),
        ('[{"id":#,"v":{"x":1}}]', '[{"id":#,"v":1,"w":2}]', True),
        ('{"id":#,"v":{"x":1,"y":#}}', '{"id":#,"v":{"x":1,"y":-1}}', False),
        ('[{"id":#,"t":"a"},{"id":#.5,"t":"b"}]', '[{"id":#.5,"t":"b"},{"id":#,"t":"a"}]', True),
    ]
    one = F.col("p_partkey") % 10
    pick = lambda n: F.element_at(F.array(*[text(f[n]) for f in forms]), one.cast("int") + 1)
    ids = F.when(F.element_at(F.array(*[F.lit(f[2]) for f in forms]), one.cast("int") + 1), F.array(F.lit("id"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        k.alias("case_id"), F.lit(1).alias("repetition"), F.lit("conformance").alias("tier"), ids.alias("identity_fields"), F.lit(False).alias("allow_additional_fields"),
        pick(0).alias("expected"), pick(1).alias("actual"), F.lit(True).alias("schema_valid"),
    )


COUNTED = ", ".join(f"CAST(n[{i + 1}] AS BIGINT) AS {c}" for i, c in enumerate(COUNTS))


@query(f"""
    SELECT CAST(p_partkey AS VARCHAR) AS case_id, {COUNTED}, p_partkey % 10 <> 1 AS json_valid, order_correct, len(kinds) = 0 AND order_correct AS exact_match
    FROM ({CASES_SQL})""")
def score_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q2, Q4, Q7, Q9: broken texts, single values, types against each other, repeated identities, arrays within."""
    return scores(compared(_case_samples(spark, sf_dir))).select("case_id", *COUNTS, "json_valid", "order_correct", "exact_match")


@query(f"""
    SELECT CAST(p_partkey AS VARCHAR) AS case_id, unnest(kinds) AS kind FROM ({CASES_SQL})""")
def score_difference_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1, Q2, Q4, Q7, Q9: the differences of the same samples."""
    return score(_case_samples(spark, sf_dir))[1].select("case_id", "kind")


# --- failures and splits -------------------------------------------------------------------------

BROKEN = 509


@query(f"""
    WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_id % 10 <> 9),
    f AS (SELECT min(n) AS first FROM e WHERE event_id % {BROKEN} = {BROKEN - 1})
    SELECT 'chunk ' || first || ': produced invalid JSON' AS error, CAST(first - 1 AS BIGINT) AS n_items, CAST(first AS BIGINT) AS n_attempts FROM f""")
def first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure in input order, and what stands before it; blank sources have no chunk."""
    key = F.col("event_id")
    content = F.when(key % 10 == 9, F.lit(" \n\t ")).when(key % BROKEN == BROKEN - 1, F.lit("{")).otherwise(F.col("props"))
    given = table(spark, sf_dir, "events").select("event_id", content.alias("content"))
    done = Engine(JsonExtractor()).attempt(from_column(given, "event_id", "content"), Request('{"type":"array"}'))
    return done.metrics().select(F.lit(done.error).alias("error"), F.col("records_produced").alias("n_items"), F.col("chunks_processed").alias("n_attempts"))


WHOLE = RuleExtractor("(?s)^(?<t>.+)$", {"t": 1})
#: In front of every name: characters of two, three and four bytes.
SIGNS = "é日😀"


def _pieces(spark: SparkSession, sf_dir: str, context: int, max_tokens: int) -> DataFrame:
    """Every nation's name with SIGNS in front of it, cut until its pieces fit, and put together again."""
    named = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit(SIGNS), "n_name").alias("content"))
    done = Engine(WHOLE, Config(context)).extract(from_column(named, "n_nationkey", "content"), Request(fields_schema("t"), max_tokens=max_tokens))
    items = typed(done.items, "value", done.prepared.item)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_in_source", "path", "item_pos", "t"))), lambda s: s["t"])
    return items.groupBy(F.col("source_index").alias("n_nationkey")).agg(F.regexp_replace(F.array_join(texts, ""), " ", "").alias("name"), (F.count("*") > 1).alias("split"))


PIECES_SQL = f"SELECT n_nationkey, replace('{SIGNS}' || n_name, ' ', '') AS name, TRUE AS split FROM nation"


@query(PIECES_SQL)
def too_long_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts that don't fit the context are cut in two, until they do, between characters."""
    return _pieces(spark, sf_dir, 600 + 20 + 2, 20)


@query(PIECES_SQL)
def cut_output_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that stop at the token limit, at times inside a character, are tried again in halves."""
    return _pieces(spark, sf_dir, 8192, 7)


@query("""
    SELECT 'regions' AS content_type, string_agg(r_name, ', ' ORDER BY r_regionkey) AS summary, count(*) AS n, 0 AS n_warnings FROM region""")
def default_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object of the default schema from all sources together."""
    r = table(spark, sf_dir, "region")
    ordered = F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name")))
    names = F.array_join(F.transform(ordered, lambda s: s["r_name"]), ", ")
    whole_object = F.struct(F.lit("regions").alias("content_type"), names.alias("summary"), F.struct(F.count("*").alias("n")).alias("attributes"), F.array().cast("array<string>").alias("warnings"))
    json_text = r.agg(F.to_json(whole_object).alias("j"))
    # in two sources: a line feed goes between them, where JSON lets it
    halves_of = json_text.select(F.posexplode(F.array(F.substring_index("j", ",", 1), F.expr("substr(j, instr(j, ','))"))).alias("source_index", "content"))
    done = Engine(JsonExtractor()).extract(halves_of, Request())
    get = lambda path, kind: F.variant_get("value", path, kind)
    return done.items.select(get("$.content_type", "string").alias("content_type"), get("$.summary", "string").alias("summary"), get("$.attributes.n", "long").alias("n"), F.size(get("$.warnings", "array<variant>")).alias("n_warnings"))

# --- results -------------------------------------------------------------------------------------


@query("""
    SELECT n_regionkey, '[' || string_agg('{"key":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']' AS document
    FROM nation GROUP BY n_regionkey""")
def json_array_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K2: items as one JSON array for each group, keys sorted."""
    value = F.parse_json(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))))
    return array_documents(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", value.alias("value")), ["n_regionkey"], ["n_nationkey"])


@query("""
    SELECT doc_id, CASE WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE n || ' B' END AS size
    FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N11."""
    return table(spark, sf_dir, "documents").select("doc_id", human_size(n_bytes(F.col("text"))).alias("size"))


@query("""
    SELECT doc_id, sha256(encode(text)) AS sha256, strlen(text) AS size FROM documents""")
def content_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N9 over a table: size and checksum of every content."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), n_bytes(F.col("text")).alias("size"))


@query(r"""
    SELECT conv_id, turn, role, regexp_replace(chr(160) || text || chr(8195) || chr(10), '^[\s\x{85}\p{Z}\v]+|[\s\x{85}\p{Z}\v]+$', '', 'g') AS trimmed FROM conversations""")
def unicode_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space of any script goes from the ends."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", trim_space(F.concat(F.lit(" "), F.col("text"), F.lit(" \n"))).alias("trimmed"))


@query("""
    SELECT event_id, k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that are JSON already, through the engine: each event's properties as a source."""
    done = Engine(JsonExtractor()).extract(sources(spark, sf_dir, "events", "event_id", "props"), Request(json.dumps({"type": "array", "items": json.loads(PROPS)})))
    return typed(done.items, "value", done.prepared.item).select(F.col("source_index").alias("event_id"), "k")
