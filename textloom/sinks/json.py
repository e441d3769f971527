"""JSON sinks.

On a cluster, write_lines() is the sink: every task writes its own part. The array
and document writers are for results that one reader wants as one JSON text; the
driver passes their items on one partition at a time and never holds them all.
"""

from __future__ import annotations

import json
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _text(value: str, compact: bool, indent: str = "") -> str:
    if compact:
        return json.dumps(json.loads(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return json.dumps(json.loads(value), sort_keys=True, indent=2, ensure_ascii=False).replace("\n", f"\n{indent}")


class ArrayWriter:
    """Writes one JSON array, item by item: start, write..., finish, each array once."""

    def __init__(self, out: TextIO, compact: bool = False):
        self.out, self.compact, self.state, self.n = out, compact, "new", 0

    def _expect(self, state: str) -> None:
        if self.state != state:
            raise RuntimeError(f"array is {self.state}, not {state}")

    def start(self) -> None:
        self._expect("new")
        self.state = "started"
        self.out.write("[")

    def write(self, item: str) -> None:
        self._expect("started")
        self.out.write("," if self.n else "")
        self.out.write(_text(item, True) if self.compact else f"\n  {_text(item, False, '  ')}")
        self.out.flush()
        self.n += 1

    def finish(self) -> None:
        self._expect("started")
        self.state = "finished"
        self.out.write("]\n" if self.compact or not self.n else "\n]\n")
        self.out.flush()


def write_array(items: DataFrame, order: list[str], out: TextIO, compact: bool = False) -> int:
    """Write the VARIANT column value of all items, sorted by `order`, as one array; the number of items."""
    writer = ArrayWriter(out, compact)
    writer.start()
    for r in items.orderBy(*order).select(F.to_json("value").alias("item")).toLocalIterator(prefetchPartitions=True):
        writer.write(r["item"])
    writer.finish()
    return writer.n


def write_document(value: str, out: TextIO, compact: bool = False) -> None:
    """Write one JSON value, with sorted keys and a line feed."""
    out.write(_text(value, compact) + "\n")
    out.flush()


def array_documents(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows `group`, document: each group's items as one compact JSON array. For groups of bounded size."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.to_json("value").alias("item"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["item"]), ",")
    return items.groupBy(*group).agg(F.concat(F.lit("["), joined, F.lit("]")).alias("document"))


def write_lines(items: DataFrame, path: str, order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write items as JSON Lines in parallel; files sort by `order`, if given. Nothing is visible before all is written."""
    placed = items.repartitionByRange(*order).sortWithinPartitions(*order) if order else items
    placed.select(F.to_json("value").alias("value")).write.mode(mode).text(path)
