"""Phrases whose words stand together more often than chance, from vertical positional lists.

Texts are cut into blocks of bounded size. A block keeps, in the shared folder, the
sorted positions of every phrase that occurs in it; a phrase is extended by merging its
positions with those of what follows one word later, so the length of a list is the
phrase's exact count in the block. The phrases of all blocks are dealt to shards: of a
block, a shard gets one row with its phrases as steps of a few bytes. It sums the
lengths, numbers what is frequent and gives each block a row that tells which of its own
phrases these are. So no row stands for one phrase of one block, no task needs all
phrases of a level, and no list leaves its block. Phrases are told by numbers, given to
frequent words and then to pairs of shorter phrases, so nothing rests on hashes.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.storage import shared_dir, shuffles_dropped
from textloom.llm.common import local_path, materialize
from textloom.llm.words import slices, words

BLANKS, BREAKS = b" \t", b".,;:!?\n\v\f\r"
LONGEST = 5
MIN_COUNT = 100
#: Per cent of a phrase's count that a longer one must have to take its place.
COVER = 100
TOP = 2000
#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 4 << 20
#: Shards of words for each shuffle partition, and occurrences in a shard of longer phrases.
SHARDS, SHARD = 4, 2 << 20
#: Parts of a language's phrases that are ranked by themselves first.
RANKED = 64

#: Rows of a block in a shard: the code of its first phrase here, and what _packed() makes of the frequent ones' places and numbers.
KNOWN = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("kept", pa.binary()), ("ids", pa.binary())])


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Whole numbers from 0, seven bits a byte, of which the last is below 128; in row i those up to ends[i]."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    to = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(to[-1], np.uint8)
    for k in range(int(sizes.max(initial=0))):
        here = np.flatnonzero(sizes > k)
        out[to[here] + k] = (values[here] >> 7 * k) & 127 | np.where(sizes[here] > k + 1, 128, 0)
    edges = to[np.concatenate([[0], ends])].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(edges), pa.py_buffer(out)])


def _unpacked(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """What _packed() was given."""
    rows = pa.concat_arrays(rows.chunks) if rows.num_chunks else pa.array([], pa.binary())
    _, places, data = rows.buffers()
    edges = np.frombuffer(places, np.int32)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int32)
    if edges[0] == edges[-1]:
        return np.zeros(0, np.int64), np.zeros(len(rows), np.int64)
    data = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = data[first] & np.int64(127)
    for k in range(1, int((last - first).max()) + 1):
        here = np.flatnonzero(last - first >= k)
        out[here] |= (data[first[here] + k] & np.int64(127)) << 7 * k
    return out, np.searchsorted(last, edges[1:] - edges[0])


def _steps(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first of a row's ascending values, and by how much each goes beyond the one before."""
    out = np.diff(values, prepend=0)
    starts = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
    out[starts] = values[starts]
    return out


def _sums(steps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, sizes = np.cumsum(steps), np.diff(ends, prepend=0)
    before = np.concatenate([[0], total])[np.concatenate([[0], ends[:-1]])]
    return total - np.repeat(before, sizes)


def _row_of(ends: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))


def _save(folder: str, block: int, level: int, place: np.ndarray, code: np.ndarray) -> None:
    """Write the lists of a block: places in ascending order, as steps, and which phrase each has.

    The file is named by block and level and holds the same whenever a task writes it again.
    """
    batch = pa.record_batch({"step": np.diff(place, prepend=0).astype(np.int32), "code": code.astype(np.int32)})
    path = f"{folder}/{level}/{block}"
    own = f"{path}.{TaskContext.get().taskAttemptId()}"
    with pa.OSFile(own, "wb") as file, pa.ipc.new_file(file, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    os.replace(own, path)


def _load(folder: str, block: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    with pa.OSFile(f"{folder}/{level}/{block}") as file:
        found = pa.ipc.open_file(file).read_all()
    return np.cumsum(found["step"].to_numpy(), dtype=np.int64), found["code"].to_numpy()


def _word_lists(folder: str, size: int, shards: int):
    """Cuts texts into blocks, writes the lists of their words and gives the words and the lists' lengths to shards, a row for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin, texts in slices(batch.column("text"), size):
                found, row, piece = words(texts, BLANKS, BREAKS)
                if not len(found):
                    continue
                coded, langs = found.dictionary_encode(), batch.column("lang").slice(begin, len(texts)).dictionary_encode()
                word, many = coded.dictionary, len(coded.dictionary)
                dealt = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) % shards for w in word), np.int64, many)
                # words in the order of shard and text, and codes by shard, language and text
                order = pc.sort_indices(word).to_numpy().astype(np.int64)
                order = order[np.argsort(dealt[order], kind="stable")]
                rank, dealt = np.empty(many, np.int64), dealt[order]
                rank[order] = np.arange(many)
                rank, first = rank[coded.indices.to_numpy()], np.searchsorted(dealt, np.arange(shards + 1))
                of, width = dealt[rank], np.diff(first)
                key = first[of] * len(langs.dictionary) + langs.indices.to_numpy()[row] * width[of] + rank - first[of]
                distinct, code, n = np.unique(key, return_inverse=True, return_counts=True)
                # a step of more than one parts the pieces
                _save(folder, block, 1, np.arange(len(found)) + piece, code)
                shard = np.searchsorted(first * len(langs.dictionary), distinct, "right") - 1
                lang, place = np.divmod(distinct - first[shard] * len(langs.dictionary), width[shard])
                start = np.flatnonzero(np.diff(shard * len(langs.dictionary) + lang, prepend=-1))
                ends = np.append(start[1:], len(distinct))
                sorted_words = word.take(pa.array(order[first[shard] + place]))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(start, len(distinct)), pa.int32()), sorted_words), pa.scalar(" ", pa.large_string())).cast(pa.string())
                columns = [shard[start].astype(np.int32), np.full(len(start), block), start, langs.dictionary.take(pa.array(lang[start])), joined, _packed(n - 1, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["shard", "block", "first", "lang", "words", "more"])
                block += 1

    return run


def _longer_lists(folder: str, level: int, base: np.ndarray, many: int, shards: int):
    """For one block, given which of its phrases of `level` words are frequent: the lists of those of one word more, dealt to shards.

    base: the number of a shard's first frequent phrase; `many` is more than the largest of
    them. A pair of them is a whole number, of which the shard is what is left by `shards`.
    """
    width = many * many // shards + 1

    def run(known: pa.Table) -> pa.Table:
        block = known["block"][0].as_py()
        kept, ends = _unpacked(known["kept"])
        row = _row_of(ends)
        kept = _sums(kept, ends) + known["first"].to_numpy()[row]
        ids = _sums(_unpacked(known["ids"])[0], ends) + base[known["shard"].to_numpy()][row]
        place, code = _load(folder, block, level)
        named = np.full(int(code.max()) + 1, -1, np.int64)
        named[kept] = ids
        code = named[code]
        place, code = place[code >= 0], code[code >= 0]
        # the merge: a frequent phrase here, and one that begins a word later
        meet = np.flatnonzero(place[1:] == place[:-1] + 1)
        rest, shard = np.divmod(code[meet] * many + code[meet + 1], shards)
        pairs, longer, n = np.unique(shard * width + rest, return_inverse=True, return_counts=True)
        if level + 1 < LONGEST and len(n):
            _save(folder, block, level + 1, place[meet], longer)
        shard, rest = np.divmod(pairs, width)
        start = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = np.append(start[1:], len(pairs))[: len(start)]
        # most occur once, which takes a bit
        more = n > 1
        columns = [shard[start].astype(np.int32), np.full(len(start), block), start, _packed(_steps(rest, ends) * 2 + more, ends), _packed(n[more] - 2, np.cumsum(more)[ends - 1])]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], ["shard", "block", "first", "pairs", "more"])

    return run


def _frequent(rows: pa.Table, ends: np.ndarray, key: np.ndarray, n: np.ndarray, min_count: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Of a shard's phrases, by the row of their block: the keys and counts of the frequent ones, and KNOWN for each block that has some."""
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) > 0
    at = np.flatnonzero(new)
    a = np.add.reduceat(n[order], at) if len(at) else n
    often = a >= min_count
    number = np.empty(len(key), np.int64)
    number[order] = np.where(often, np.cumsum(often) - 1, -1)[np.cumsum(new) - 1]
    kept = np.flatnonzero(number >= 0)
    place = kept - np.concatenate([[0], ends])[_row_of(ends)[kept]]
    to = np.searchsorted(kept, ends)
    columns = [rows["shard"], rows["block"], rows["first"], _packed(_steps(place, to), to), _packed(_steps(number[kept], to), to)]
    return key[order][at][often], a[often], pa.table(columns, KNOWN.names).filter(pa.array(np.diff(to, prepend=0) > 0))


def _found(shard: int, phrases: dict, a: np.ndarray, known: pa.Table, names: list[str], totals: dict | None = None) -> pa.Table:
    """Rows of all kinds: `pos` and what the phrase is for a frequent one, KNOWN for a block, and the languages' numbers of words."""
    told = pa.table({"shard": pa.array(np.full(len(a), shard), pa.int32()), "pos": pa.array(np.arange(len(a))), **phrases, "a": pa.array(a)})
    tables = [told, known, *([pa.table(totals)] if totals else [])]
    out = pa.concat_tables(tables, promote_options="default")
    return out.select(names)


def _words_found(min_count: int, names: list[str]):
    def run(rows: pa.Table) -> pa.Table:
        more, ends = _unpacked(rows["more"])
        rows = rows.combine_chunks()
        found, _, _ = words(rows["words"].chunk(0).cast(pa.large_string()), BLANKS)
        coded, langs = found.dictionary_encode(), rows["lang"].chunk(0).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lang = langs.indices.to_numpy().astype(np.int64)[_row_of(ends)]
        key, a, known = _frequent(rows, ends, lang * len(order) + rank[coded.indices.to_numpy()], more + 1, min_count)
        of, word = np.divmod(key, len(order))
        phrases = {"lang": langs.dictionary.take(pa.array(of)), "word": coded.dictionary.take(pa.array(order[word])).cast(pa.string())}
        totals = {"lang": langs.dictionary, "a": pa.array(np.bincount(lang, more + 1, len(langs.dictionary)).astype(np.int64))}
        return _found(rows["shard"][0].as_py(), phrases, a, known, names, totals)

    return run


def _pairs_found(min_count: int, many: int, shards: int, names: list[str]):
    def run(rows: pa.Table) -> pa.Table:
        shard = rows["shard"][0].as_py()
        pairs, ends = _unpacked(rows["pairs"])
        n = np.ones(len(pairs), np.int64)
        n[pairs & 1 == 1] = _unpacked(rows["more"])[0] + 2
        key, a, known = _frequent(rows, ends, _sums(pairs >> 1, ends), n, min_count)
        left, right = np.divmod(key * shards + shard, many)
        return _found(shard, {"left": pa.array(left), "right": pa.array(right)}, a, known, names)

    return run


def _numbered(dealt: DataFrame, run, by: dict[str, str], shards: int) -> tuple[DataFrame, DataFrame, np.ndarray, int]:
    """What `run` finds in each shard: rows id, `by`, a of the frequent phrases; the other rows; the numbers' base in each shard; all occurrences.

    A shard's phrases have numbers in a row. What reaches the driver is a row for each shard.
    """
    names = ["shard", "pos", *by, "a", "block", "first", "kept", "ids"]
    types = {"shard": "int", "kept": "binary", "ids": "binary"} | by
    with shuffles_dropped(dealt.sparkSession):
        rows = materialize(dealt.groupBy("shard").applyInArrow(run(names), ", ".join(f"{c} {types.get(c, 'long')}" for c in names)))
    found = rows.filter("pos is not null")
    sizes, total = np.zeros(shards, np.int64), 0
    for r in found.groupBy("shard").agg(F.count("*").alias("n"), F.sum("a").alias("a")).collect():
        sizes[r["shard"]] = r["n"]
        total += r["a"]
    base = np.concatenate([[0], np.cumsum(sizes)])
    bases = F.broadcast(dealt.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(base)], "shard int, base long"))
    found = found.join(bases, "shard").select((F.col("base") + F.col("pos")).alias("id"), *by, "a")
    return found, rows.filter("pos is null"), base, total


def phrases(documents: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases of 2 to `longest` words (5 at most), and rows lang, n with the number of words of each language.

    Rows id, lang, phrase, size, a, heads, tails, left, right. a: occurrences, overlaps
    included; heads, tails: those of the first 1, 2, ... words and of the last 1, 2, ...;
    left, right: the id of the phrase without its last word and without its first. A null
    text is empty, a null lang is `und`, a null id is a document like others. No documents, no rows.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    spark = documents.sparkSession
    folder = f"{local_path(shared_dir(spark))}/lists-{uuid.uuid4().hex}"
    for level in range(1, LONGEST):
        os.makedirs(f"{folder}/{level}")
    docs = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, common = SHARDS * partitions, "shard int, block long, first long, "
    dealt = docs.mapInArrow(_word_lists(folder, block, shards), f"{common}lang string, words string, more binary")
    found, known, base, total = _numbered(dealt, lambda names: _words_found(min_count, names), {"lang": "string", "word": "string"}, shards)
    sizes = known.filter("block is null").groupBy("lang").agg(F.sum("a").alias("n"))
    none = F.array().cast("array<long>")
    shorter = found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"))
    levels = []
    for level in range(1, longest):
        # no more pairs than occurrences: shards stay small, however many there are
        shards = max(partitions, -(-total // SHARD))
        many = max(int(base[-1]), 1)
        while gcd(many, shards) > 1:
            many += 1
        lists = _longer_lists(folder, level, base, many, shards)
        dealt = known.filter("block is not null").select("shard", "block", "first", "kept", "ids").groupBy("block").applyInArrow(lists, f"{common}pairs binary, more binary")
        counted = lambda names: _pairs_found(min_count, many, shards, names)  # noqa: B023, E731
        found, known, base, total = _numbered(dealt, counted, {"left": "long", "right": "long"}, shards)
        shutil.rmtree(f"{folder}/{level}", ignore_errors=True)
        left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), F.concat("heads", F.array("a")).alias("heads"))
        right = shorter.select(F.col("id").alias("right"), "last", F.concat("tails", F.array("a")).alias("tails"))
        named = found.join(left, "left").join(right, "right")
        named = named.select("id", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "a", "heads", "tails", F.lit(level + 1).alias("size"), "left", "right")
        # the next level reads it twice
        shorter = materialize(named)
        levels.append(shorter.drop("last"))
    # every list has been read: what is left to do rests on written tables
    shutil.rmtree(folder, ignore_errors=True)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out, sizes


def collocations(documents: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """Rows lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language in whole `documents` (lang, text).

    A cut of a phrase scores floor(1000 a n / (l r)), l and r being the counts of its two
    sides, and the lowest cut counts, the earliest of several. A phrase goes if a longer
    frequent one that has it inside has `cover` per cent of its count. Phrases of one word
    more tell: any longer one has such a phrase inside, which is no rarer. Ties go to the
    more frequent, then to the smaller in UTF-8.
    """
    found, sizes = phrases(documents, longest, min_count, block)
    inside = found.select("size", "a", F.explode(F.array("left", "right")).alias("of"))
    inside = inside.groupBy((F.col("size") - 1).alias("of_size"), "of").agg(F.max("a").alias("most"))
    joined = found.join(inside, (F.col("size") == F.col("of_size")) & (F.col("id") == F.col("of")), "left")
    left = joined.filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("a") * cover))
    # one row a language: as many as there are languages
    left = left.join(sizes, "lang")
    # decimals of 38 digits hold a product of two counts, and a thousand times that
    score = "(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0)))"
    side = {"l": "element_at(heads, k)", "r": "element_at(tails, size - k)"}
    cuts = f"transform(sequence(1, size - 1), k -> struct({score.format(**side)} as score, k as k, {side['l']} as l, {side['r']} as r))"
    scored = left.withColumn("cut", F.array_min(F.expr(cuts))).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may have most of all phrases: its parts are ranked first
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED))
    first = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*best))).filter(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
