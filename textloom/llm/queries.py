"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.collocations import COVER, LONGEST, MIN_COUNT, TOP, collocations
from textloom.llm.common import UPPER, table
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.filter_audit import audit
from textloom.llm.html_extraction import extract
from textloom.llm.language_id import identify
from textloom.llm.line_dedup import MIN_SITES, line_dedup
from textloom.llm.ngram_model import language_model_scores
from textloom.llm.packing import best_fit
from textloom.llm.secret_scan import digest, scan
from textloom.llm.simhash import simhash_components
from textloom.llm.source_mixing import mix
from textloom.llm.token_counts import length_histogram, token_counts
from textloom.llm.vector_search import nearest


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_lines", "n_removed", "text")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "chars", "block", "slot", "offset")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_vector_search": op5_vector_search,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_collocations": op11_collocations,
    "op12_filter_audit": op12_filter_audit,
    "op13_language_model": op13_language_model,
}

ORACLES = {
    "op1_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents),
        bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM lines),
        spread AS (
            SELECT b, min((doc_id, pos)) AS first FROM bare WHERE b <> ''
            GROUP BY b HAVING count(DISTINCT source) >= {MIN_SITES}),
        marked AS (
            SELECT bare.*, spread.b IS NOT NULL AND (doc_id, pos) <> spread.first AS cut
            FROM bare LEFT JOIN spread ON bare.b = spread.b)
        SELECT doc_id, source, count(*) AS n_lines, CAST(count(*) FILTER (cut) AS BIGINT) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS text
        FROM marked GROUP BY doc_id, source""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY t)""",
    "op11_collocations": f"""
        WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        sized AS (SELECT lang, w, unnest(range(1, {LONGEST + 1})) AS k FROM w),
        starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized WHERE len(w) >= k),
        f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
        cuts AS (
            SELECT c.lang, c.phrase, c.a, c.k, h.k AS head, h.a AS l, t.a AS r, n,
                   CAST((1000::HUGEINT * c.a * n) // (h.a::HUGEINT * t.a) AS BIGINT) AS score
            FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS head FROM f WHERE k > 1) c
            JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.head], ' ')
            JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.head + 1:], ' ')
            JOIN sizes ON sizes.lang = c.lang),
        lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, head) = 1),
        inside AS (
            SELECT g.lang, array_to_string(g.w[i:i + m - 1], ' ') AS phrase, max(g.a) AS most
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2)) g
            GROUP BY ALL),
        kept AS (
            SELECT c.* FROM lowest c LEFT JOIN inside s ON s.lang = c.lang AND s.phrase = c.phrase
            WHERE s.most IS NULL OR 100 * s.most < {COVER} * c.a)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept QUALIFY rank <= {TOP}""",
    "op12_filter_audit": """
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        flags AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
                'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
                'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > first, false)} AS f
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        steps AS (
            SELECT part, good, toxic, filter_order, step, f[substr(filter_order, step, 1)] AS own,
                   len(list_filter(map_values(f), lambda v: v)) AS n_failed,
                   coalesce(list_min(list_filter(range(1, 6), lambda i: f[substr(filter_order, i, 1)])), 6) AS first
            FROM flags, orders, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)),
        counted AS (
            SELECT part, filter_order, step, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
                   count(*) FILTER (own AND first < step) AS redundant, count(*) FILTER (own AND n_failed = 1) AS unique_fails,
                   count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
            FROM steps GROUP BY part, filter_order, step)
        SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM counted""",
}
