"""Words of many texts at once, as numbers.

Bytes are classed by a table and words are cut out of them by array operations; no
Python loop goes over words. UTF-8 keeps ASCII separators apart from all else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; a longer text is looked at alone.
SLICE = 8 << 20


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """Runs of rows of some `size` bytes at most, each with its first row's place; A-Z lower-cased, null as empty."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield begin, texts.slice(begin, end - begin)
        begin = end


def words(texts: pa.LargeStringArray, blanks: bytes, breaks: bytes = b"") -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """All words in order: their texts, the row of each, and its piece; texts are not null.

    A word is a run of bytes that are neither blanks nor breaks. A piece ends at every
    break and at the end of its row; pieces are counted over all rows.
    """
    _, places, data = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    empty = pa.array([], pa.large_string())
    if data is None or at[0] == at[-1]:
        return empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    is_word = np.ones(256, bool)
    is_word[list(blanks + breaks)] = False
    inside = is_word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # a row's words end with it; rows may be empty
    starts = at[:-1][at[:-1] < len(data)]
    first[starts] = inside[starts]
    last[starts[starts > 0] - 1] = inside[starts[starts > 0] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(end - begin)])
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    row = np.searchsorted(at, begin, "right") - 1
    broken = np.zeros(256, bool)
    broken[list(breaks)] = True
    return found, row, row + np.searchsorted(np.flatnonzero(broken[data]), begin)
