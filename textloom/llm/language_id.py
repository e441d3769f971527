"""Language ID: multinomial naive Bayes over hashed character n-grams.

Every text gives its 1-, 2- and 3-grams of lower-cased characters, hashed into
2^BUCKET_BITS buckets. Training sums the buckets' counts for each language over
all labelled rows, in the tasks and then in Spark; the matrix of log
probabilities, languages x buckets, is broadcast; scoring is sparse: a batch of
texts looks up the rows of the buckets that it has, a long text each of them once,
with its count. Languages beyond LANGUAGES_AT_ONCE have further matrices, which
texts pass one after another; what each finds best adds up to the whole posterior.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

BUCKET_BITS = 15
SMOOTHING = 0.5
#: Bounds a matrix: 256 languages x 2^15 buckets x 4 bytes are 32 MB.
LANGUAGES_AT_ONCE = 256
#: Languages whose counts a training task holds before it passes them on: 256 KB each.
COUNTED_AT_ONCE = 64
#: Characters of one text that are hashed at once.
STRETCH = 1 << 20
#: Cells, n-grams x languages, that are looked up at once.
CELLS_AT_ONCE = 1 << 22
UNDETERMINED = "und"
ORDER = 3


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, a stretch of it after another."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    for at in range(0, max(1, len(codes)), STRETCH):
        # longer n-grams may begin in this stretch and end in the next one
        own = codes[at : at + STRETCH + ORDER - 1]
        found, h = [], own * np.uint32(0x9E3779B1)
        for n in range(1, ORDER + 1):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + own[n - 1 :]
            mixed = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35 + 2 * n)
            found.append((mixed >> np.uint32(32 - BUCKET_BITS))[:STRETCH])
        yield np.concatenate(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, bucket, n; bucket -1 has the number of texts."""
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, np.int64))
    texts: dict[str, int] = defaultdict(int)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in texts.items():
            used = np.flatnonzero(counts[lang])
            buckets, values = np.concatenate(([-1], used)), np.concatenate(([n], counts[lang][used]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(buckets)), pa.array(buckets), pa.array(values)], ["lang", "bucket", "n"])
        counts.clear()
        texts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang = lang.as_py()
            if lang not in texts and len(texts) >= COUNTED_AT_ONCE:
                yield from flush()
            texts[lang] += 1
            for x in grams(text.as_py()):
                counts[lang] += np.bincount(x, minlength=1 << BUCKET_BITS)
    yield from flush()


class Model:
    """Languages and their log probabilities; `weights` has a row for each bucket."""

    def __init__(self, languages: list[str], prior: np.ndarray, weights: np.ndarray):
        self.languages, self.prior, self.weights = languages, prior, weights

    def logs(self, texts: list[str]) -> np.ndarray:
        """Texts x languages: log of prior times likelihood."""
        totals = np.tile(self.prior, (len(texts), 1))
        most = max(1, CELLS_AT_ONCE // len(self.languages))
        pending: list[tuple[int, np.ndarray]] = []
        size = 0

        def add() -> None:
            rows, found = [i for i, _ in pending], [x for _, x in pending]
            starts = np.cumsum([0, *map(len, found)])[:-1]
            sums = np.add.reduceat(self.weights[np.concatenate(found)], starts, axis=0, dtype=np.float64)
            np.add.at(totals, rows, sums)
            pending.clear()

        for i, text in enumerate(texts):
            for x in grams(text):
                if len(x) > min(most, 1 << BUCKET_BITS):
                    # a long text: each of its buckets once, by count
                    n = np.bincount(x, minlength=1 << BUCKET_BITS)
                    used = np.flatnonzero(n)
                    for at in range(0, len(used), most):
                        some = used[at : at + most]
                        totals[i] += n[some] @ self.weights[some].astype(np.float64)
                elif len(x):
                    if size + len(x) > most and pending:
                        add()
                        size = 0
                    pending.append((i, x))
                    size += len(x)
        if pending:
            add()
        return totals


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train(labelled: DataFrame) -> list[Model]:
    """A model of the columns text and lang for each LANGUAGES_AT_ONCE languages; rows with a null in either are left out.

    All rows count, and are read once. What reaches the driver at a time are at most
    LANGUAGES_AT_ONCE x 2^BUCKET_BITS sums. Without rows there is no model, and every
    text is undetermined.
    """
    rows = labelled.select("lang", "text").filter("lang is not null and text is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    sums = materialize(sums.select("lang", F.col("bucket").cast("int").alias("bucket"), "n"))
    found = sums.filter("bucket = -1").select("lang", "n").toArrow().sort_by("lang").to_pylist()
    texts = sum(r["n"] for r in found)
    models = []
    for at in range(0, len(found), LANGUAGES_AT_ONCE):
        some = found[at : at + LANGUAGES_AT_ONCE]
        numbers = labelled.sparkSession.createDataFrame([(r["lang"], i) for i, r in enumerate(some)], "lang string, row int")
        cells = sums.filter("bucket >= 0").join(F.broadcast(numbers), "lang").select("row", "bucket", "n").toArrow()
        counts = np.zeros((1 << BUCKET_BITS, len(some)))
        counts[cells["bucket"].to_numpy(), cells["row"].to_numpy()] = cells["n"].to_numpy()
        totals = counts.sum(axis=0) + SMOOTHING * len(counts)
        counts += SMOOTHING
        np.log(counts, out=counts)
        counts -= np.log(totals)
        models.append(Model([r["lang"] for r in some], np.log([r["n"] / texts for r in some]), counts.astype(np.float32)))
    return models


def predict(texts: DataFrame, models: list[Model], key_columns: list[str]) -> DataFrame:
    """`key_columns`, lang_pred and score for every row; only the column text is looked at.

    A text that is null or has no letter is `und` with score 0; otherwise score is
    the posterior probability of the language, ties going to the first by name.
    Columns of any name may be keys.
    """
    keys = [f"_key_{i}" for i in range(len(key_columns))]
    slim = texts.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(key_columns, keys, strict=True)], F.col("text").alias("_text"))
    # the best language so far, its log, and the sum of all likelihoods divided by its own
    found = slim.withColumns({"_best": F.lit(None).cast("string"), "_log": F.lit(float("-inf")), "_sum": F.lit(0.0)})

    def judge(model: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("_text").to_pylist()
        best, log, total = (batch.column(c).to_pylist() for c in ("_best", "_log", "_sum"))
        judged = [i for i, t in enumerate(text) if has_letter(t)]
        if judged:
            logs = model.logs([text[i] for i in judged])
            at = logs.argmax(axis=1)
            top = logs[np.arange(len(at)), at]
            sums = np.exp(logs - top[:, None]).sum(axis=1)
            for n, i in enumerate(judged):
                if top[n] > log[i]:
                    total[i] = float(sums[n]) + total[i] * float(np.exp(log[i] - top[n]))
                    best[i], log[i] = model.languages[at[n]], float(top[n])
                else:
                    total[i] += float(sums[n] * np.exp(top[n] - log[i]))
        columns = [pa.array(best, pa.string()), pa.array(log, pa.float64()), pa.array(total, pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], names=batch.schema.names)

    for model in models:
        shared = texts.sparkSession.sparkContext.broadcast(model)
        found = found.mapInArrow(lambda batches, shared=shared: (judge(shared.value, b) for b in batches), found.schema)
    last = [F.coalesce("_best", F.lit(UNDETERMINED)), F.when(F.col("_best").isNotNull(), 1 / F.col("_sum")).otherwise(0.0)]
    return found.select(*keys, *last).toDF(*key_columns, "lang_pred", "score")


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that training never sees; those with a null id are trained on."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    The model learns from text and non-null lang of the rows that are not held
    out. Repeated rows give repeated results; an empty table gives no rows; other
    columns are not read.
    """
    models = train(documents.filter(~held_out()))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, models, ["doc_id", "held_out"])


def keep_identified(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """`documents` without those whose language is undetermined or scores below `least`."""
    models = train(documents.filter(~held_out()))
    columns = documents.columns
    # columns may be called lang_pred or score as well
    found = predict(documents, models, columns).toDF(*[f"_{i}" for i in range(len(columns))], "_lang", "_score")
    found = found.filter((F.col("_lang") != UNDETERMINED) & (F.col("_score") >= least))
    return found.drop("_lang", "_score").toDF(*columns)
