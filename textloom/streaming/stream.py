"""Structured Streaming: files that arrive are sources, and their items leave as JSON Lines.

A chunk never spans files, so that micro-batches are independent and the stream
keeps no state but which files it has read. Order is kept by columns: the batch,
the file, and the places of chunk and item.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.model import Request
from textloom.plans.engine import Engine, Extraction, NoInput


def file_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Streaming sources: source_name and content, a row for each file that appears in `path`."""
    read = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", per_batch).text(path)
    return read.select(F.col("_metadata.file_path").alias("source_name"), F.col("value").alias("content"))


def extract_stream(stream: DataFrame, engine: Engine, request: Request, out: str, checkpoint: str, on_batch: Callable[[int, Extraction], None] | None = None, strict: bool = True) -> StreamingQuery:
    """Start extracting; each batch's items are written to `out`/batch=N, once even if the batch runs again.

    `strict` stops the stream at a failure before anything of its batch is
    written; otherwise what stands before the failure is written. Batches without
    input write nothing.
    """

    def one(batch: DataFrame, n: int) -> None:
        # the file's name orders the batch; as a key it needs no numbering
        sources = batch.select(F.col("source_name").alias("source_index"), "content")
        try:
            done = engine.attempt(sources, request)
        except NoInput:
            return
        if strict:
            done.raise_for_error()
        lines = done.items.select(F.col("source_index").alias("source_name"), "chunk_in_source", "path", "item_pos", F.to_json("value").alias("value"))
        lines.write.mode("overwrite").json(f"{out}/batch={n}")
        if on_batch:
            on_batch(n, done)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
