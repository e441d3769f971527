"""Token counts by an exact length histogram.

Each document is encoded once; documents are aggregated by encoded length. All
later questions (totals, quantiles, what a context limit would cut) are answered
from sums over the histogram, which has a row for each length that occurs.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize, running_totals

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenizer expression of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The expression that leaves a text as one piece.
WHOLE = r"(?s).+"
#: White space is cut out of a text from this many characters on.
LONG_BLANKS = 10_000
#: The characters that \s stands for in PATTERN.
_long_blanks = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_BLANKS)
#: Lengths that one window task of the running sums gets.
STRETCH = 1024


@lru_cache(maxsize=4)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def _count(ranks: bytes, pattern: str, text: str) -> int:
    """How many tokens a text has.

    The encoder steps back through white space and holds a place for each character of
    it, so long runs are cut out. By PATTERN all of a run but its last character is one
    piece, and all of it at the end of a text; nothing before or after it is split otherwise.
    """
    encode = _encoder(ranks, pattern).encode_ordinary
    if pattern != PATTERN or len(text) < LONG_BLANKS:
        return len(encode(text))
    n, done = 0, 0
    for run in _long_blanks.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encode(text[done : run.start()])) + len(_encoder(ranks, WHOLE).encode_ordinary(text[run.start() : end]))
        done = end
    return n + len(encode(text[done:]))


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Rows doc_id, n_tokens, one per input row; a null or empty text has 0.

    `vocabulary` is a path on the driver to a file of ranks, about a megabyte, which
    is broadcast. Special tokens in a text count as ordinary text. By PATTERN texts and
    their runs of any kind may be of any length; another pattern has to see to that itself.
    """
    with open(vocabulary, "rb") as file:
        ranks = documents.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_count(ranks.value, pattern, t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """The histogram of `n_tokens` with its sums, a row for each length.

    docs, tokens: with that very length; docs_below, tokens_below: shorter;
    docs_from, tokens_from: of that length or longer (the suffix sums);
    truncated_total: tokens left if every document is cut to that length; share:
    of documents with at most that length. An empty table gives no rows.
    """
    bars = counts.groupBy("n_tokens").agg(F.count("*").alias("docs")).withColumn("tokens", F.col("docs") * F.col("n_tokens"))
    # read more than once below; the texts are encoded once
    bars = materialize(bars)
    # two numbers
    totals = bars.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    all_docs, all_tokens = (F.lit(x).cast("long") for x in totals)
    summed = running_totals(bars, [], F.floor(F.col("n_tokens") / STRETCH), ["n_tokens"], {"docs_below": "docs", "tokens_below": "tokens"})
    return summed.select(
        "n_tokens", "docs", "tokens", "docs_below", "tokens_below",
        (all_docs - F.col("docs_below")).alias("docs_from"),
        (all_tokens - F.col("tokens_below")).alias("tokens_from"),
        (F.col("tokens_below") + F.col("n_tokens") * (all_docs - F.col("docs_below"))).alias("truncated_total"),
        ((F.col("docs_below") + F.col("docs")) / all_docs).alias("share"),
    )


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that a share `q` of the documents does not exceed; None for no documents."""
    return histogram.filter(F.col("share") >= q).agg(F.min("n_tokens").alias("n")).first()["n"]


def truncated_total(histogram: DataFrame, limit: int) -> tuple[int, int]:
    """Tokens left, and documents cut, if every document is cut to `limit` tokens; any limit, occurring or not."""
    cut = F.col("n_tokens") > limit
    row = histogram.agg(
        F.sum(F.when(cut, F.col("docs") * limit).otherwise(F.col("tokens"))).alias("tokens"), F.sum(F.when(cut, F.col("docs")).otherwise(0)).alias("cut")
    ).first()
    return row["tokens"] or 0, row["cut"] or 0
