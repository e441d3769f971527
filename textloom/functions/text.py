"""Text functions: literal splitting, Unicode trimming, byte sizes, delimiters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a delimiter on a command line.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "\\": "\\"}
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def split_literal(text: Column, delimiter: str) -> Column:
    """Split at every occurrence of `delimiter`, taken as it is; parts may be empty."""
    parts = delimiter.split("\\E")
    return F.split(text, "\\\\E".join(f"\\Q{p}\\E" for p in parts))


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def is_blank(text: Column) -> Column:
    return trim_space(text) == ""


def n_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def decode_delimiter(value: str) -> str:
    """The delimiter that an argument stands for; it may be several characters long."""
    if not value:
        raise ValueError("delimiter must not be empty")

    def one(m: re.Match) -> str:
        if m[1] not in ESCAPES:
            raise ValueError(f"unsupported delimiter escape {m[0]!r}" if m[1] else "delimiter ends in a single backslash")
        return ESCAPES[m[1]]

    return re.sub(r"\\(.?)", one, value, flags=re.DOTALL)


def encode_delimiter(delimiter: str) -> str:
    """An argument that decode_delimiter turns into `delimiter`."""
    back = {c: f"\\{e}" for e, c in ESCAPES.items()}
    return "".join(back.get(c, c) for c in delimiter)


def ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the denominator is 0 or null."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double")).otherwise(F.lit(0.0))


def human_size(size: Column) -> Column:
    """Bytes as text: whole bytes below 1024, else one decimal, halves to even, in steps of 1024 up to TB."""
    out = F.format_string("%d B", size.cast("long"))
    for i, unit in enumerate(SIZE_UNITS[1:], 1):
        out = F.when(size >= 1024**i, F.format_string(f"%.1f {unit}", F.rint(size.cast("double") * 10 / float(1024**i)) / 10)).otherwise(out)
    return out
