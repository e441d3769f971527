"""JSON functions: a strict parser to VARIANT, canonical texts, flattening."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between the parts of a flattened path.
STEP = "\x1f"


def last_key_wins(spark: SparkSession) -> None:
    """Let repeated object keys be read as the last of them, as strict_json expects."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def strict_json(text: Column) -> Column:
    """The VARIANT that `text` stands for, or null if it isn't exactly one JSON value.

    The parser itself ignores what follows a value. So the text is parsed twice,
    as the only element of an array and as the only member of an object: text that
    closes the one early leaves the other broken. Numbers beyond doubles, which
    the parser reads as infinity, are refused.
    """
    in_array = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    value = F.variant_get(in_object, "$.v", "variant")
    overflow = F.when(text.rlike(r"[eE][+]?\d{3}|\d{309}"), F.contains(F.to_json(value), F.lit('Infinity"')) & ~F.contains(text, F.lit("Infinity"))).otherwise(F.lit(False))
    return F.when((F.size(in_array) == 1) & in_object.isNotNull() & ~overflow, value)


def with_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the VARIANT of column `text`, parsed once for each row however often it is used.

    Spark would repeat the parser in every expression and filter that uses its
    result; it doesn't move the generator that `once` makes.
    """
    return once(df, strict_json(F.col(text)), name)


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """`df` with a column that is computed once for each row, where Spark would copy its expression to every use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def kind(value: Column) -> Column:
    """The JSON type of a VARIANT: object, array, string, boolean, null or number; SQL null stays null."""
    name = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)
    return (
        F.when(name.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(name))
        .when(name == "VOID", F.lit("null"))
        .when(value.isNotNull(), F.lit("number"))
    )


def is_kind(value: Column, name: str) -> Column:
    """Whether a VARIANT is of that JSON type; of an array or object no more than its first level is looked at. False for SQL null."""
    if name in ("object", "array"):
        return (members(value) if name == "object" else elements(value)).isNotNull()
    of = F.coalesce(F.schema_of_variant(value), F.lit(""))
    if name == "number":
        # texts and booleans could be cast as well
        return F.try_variant_get(value, "$", "double").isNotNull() & ~of.isin("STRING", "BOOLEAN")
    return of == {"string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}[name]


def elements(value: Column) -> Column:
    """The elements of a VARIANT array; null for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    """The members of a VARIANT object as a map; null for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def member(value: Column, name: str) -> Column:
    """A member of a VARIANT object by its name, whatever characters that has; SQL null if there is none."""
    for quote in "'\"":
        if quote not in name:
            return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")
    # a path cannot hold both quotes
    return F.get(F.map_values(F.map_filter(members(value), lambda k, _: k == F.lit(name))), F.lit(0))


def _refuse(name: str):
    raise ValueError(name)


def _number(text: str) -> float | int:
    if math.isinf(value := float(text)):
        raise ValueError("number out of range")
    if not value.is_integer() or abs(value) >= 1e21:
        return value
    # the shortest digits that tell the double, with zeros after them
    return int(value) if abs(value) < 1 << 53 else int(Decimal(repr(value)))


_decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=lambda text: int(text) if len(text) < 16 else _number(text), parse_float=_number)


def _load(text: str):
    return _decoder.decode(text)


#: A string, or a number that is written with a negative power of ten.
_small = re.compile(r'"(?:[^"\\]|\\.)*"|(-?[0-9.]+e-[0-9]+)')
_lone = re.compile("[\ud800-\udfff]")
#: ASCII that is written as it is.
_plain = re.compile(r"[ !#-%'-;=?-\[\]-~]*").fullmatch
#: Characters that are written as escapes.
ESCAPED = {ord(c): f"\\u{ord(c):04x}" for c in "<>&\u2028\u2029"}


def _small_number(found: re.Match) -> str:
    """Plain digits down to 0.000001, and then powers without leading zeros."""
    if not (text := found[1]):
        return found[0]
    if abs(float(text)) >= 1e-6:
        return format(Decimal(text), "f")
    digits, power = text.split("e-")
    return f"{digits}e-{int(power)}"


_encoder = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _dump(value) -> str:
    """Sorted keys and no blanks; whole doubles as whole numbers; half of a surrogate pair is U+FFFD."""
    # most values are one of these, and need no more
    of = type(value)
    if of is int:
        return str(value)
    if of is str and _plain(value):
        return f'"{value}"'
    if of is float and 1e-4 <= abs(value) < 1e16:
        return repr(value)
    text = _encoder.encode(value).translate(ESCAPED)
    if "e-" in text:
        text = _small.sub(_small_number, text)
    return _lone.sub("\ufffd", text)


def _canonical(text: str | None) -> str | None:
    try:
        return None if text is None else _dump(_load(text))
    except (ValueError, RecursionError):
        return None


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def add_canonical(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """`df` with canonical forms, name -> column of JSON text: equal for equal values.

    Keys are sorted and numbers are doubles. Null for null and invalid texts.
    """
    kept = [c for c in df.columns if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pa.array([_canonical(t) for t in batch.column(c).to_pylist()], pa.string()) for c in columns.values()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *found], [*kept, *columns])

    return df.mapInArrow(run, ", ".join(filter(None, [_fields(df, kept), *(f"`{n}` string" for n in columns)])))


def _flat(value) -> list[dict]:
    out, left = [], [("", None, value)]
    while left:
        path, parent, v = left.pop()
        out.append({"path": path, "parent": parent, "is_object": isinstance(v, dict), "value": _dump(v)})
        if isinstance(v, dict):
            left += [(path + STEP + k, path, x) for k, x in v.items()]
    return out


OPENED = pa.schema([("side", pa.string()), ("pos", pa.int32()), ("single", pa.bool_()), ("identity", pa.string()), ("path", pa.string()), ("parent", pa.string()), ("is_object", pa.bool_()), ("value", pa.string())])


def _read(text: str | None) -> tuple:
    """A tuple of the value, or none."""
    try:
        return () if text is None else (_load(text),)
    except (ValueError, RecursionError):
        return ()


def _open(values: dict[str, tuple], fields: list[str]) -> Iterator[tuple]:
    """The rows of OPENED for the texts of one row."""
    arrays = [isinstance(v[0], list) for v in values.values() if v]
    for side, v in values.items():
        if not v:
            continue
        is_array = isinstance(v[0], list)
        yield side, -1, not is_array, None, None, None, None, "array" if is_array else "other"
        if len(arrays) < len(values) or any(arrays) != all(arrays):
            continue
        for pos, record in enumerate(v[0] if is_array else [v[0]]):
            known = is_array and fields and isinstance(record, dict) and all(f in record for f in fields)
            identity = _dump([record[f] for f in fields]) if known else None
            for r in _flat(record):
                yield side, pos, not is_array, identity, r["path"], r["parent"], r["is_object"], r["value"]


def opened_rows(df: DataFrame, keys: list[str], sides: list[str], fields: str) -> DataFrame:
    """Rows `keys` and OPENED: for the JSON texts in the columns `sides`, their records and all members of objects, at any depth.

    A text that is JSON gives a row of pos -1 whose value says whether it is an array
    or something else. If all texts of a row are arrays, or none is, each of their
    elements, or else the text as a whole, is a record: a row of the empty path and of
    no parent, and one for each member of its objects. Arrays within are not entered.
    Values are canonical; identity, the same for all rows of a record, is the tuple of
    the members named in `fields`, if it has them all.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, held = [], [], 0

            def flush() -> pa.RecordBatch:
                columns = [batch.column(k).take(pa.array(places, pa.int64())) for k in keys]  # noqa: B023
                columns += [pa.array([r[n] for r in rows], field.type) for n, field in enumerate(OPENED)]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns, [*keys, *OPENED.names])

            for i in range(len(batch)):
                for r in _open({s: _read(batch.column(s)[i].as_py()) for s in sides}, batch.column(fields)[i].as_py() or []):
                    rows.append(r)
                    places.append(i)
                    held += ROW + len(r[4] or "") + len(r[7])
                    if held >= PIECE:
                        yield flush()
                        rows, places, held = [], [], 0
            yield flush()

    return df.mapInArrow(run, f"{_fields(df, keys)}, side string, pos int, single boolean, identity string, path string, parent string, is_object boolean, value string")


#: Characters that a task holds of what it makes out of texts, before it passes them on; and what a row counts for beside its texts.
PIECE, ROW = 4 << 20, 100

NOTHING = object()
MEMBER = pa.struct([("path", pa.string()), ("expected", pa.string()), ("actual", pa.string()), ("objects", pa.bool_())])
MET = pa.schema([("shape", pa.string()), ("unique", pa.bool_()), ("at", pa.string()), ("expected_pos", pa.int32()), ("actual_pos", pa.int32()), ("members", pa.list_(MEMBER))])


def _meet(expected, actual, out: tuple[list, list, list, list]) -> int:
    """Append the members of two values to the columns of MEMBER, and tell how much that is; those below a value that isn't an object on both sides are left out."""
    paths, expecteds, actuals, objects = out
    left, size = [("", expected, actual)], 0
    # it grows while it is gone through
    for path, e, a in left:
        both = type(e) is dict and type(a) is dict
        of_e = of_a = None
        if both:
            below = path + STEP
            left += [(below + k, v, a.get(k, NOTHING)) for k, v in e.items()]
            if e.keys() != a.keys():
                left += [(below + k, NOTHING, a[k]) for k in a.keys() - e.keys()]
            size += ROW + len(path)
        elif a is NOTHING:
            of_e = _dump(e)
            size += ROW + len(path) + len(of_e)
        elif e is NOTHING:
            of_a = _dump(a)
            size += ROW + len(path) + len(of_a)
        else:
            of_e = _dump(e)
            # most members are as expected; true is no 1, and what is in arrays may be either
            of_a = of_e if (type(e) is str or type(e) is int) and type(e) is type(a) and e == a else _dump(a)
            size += ROW + len(path) + len(of_e) + len(of_a)
        paths.append(path if path.isascii() else _lone.sub("\ufffd", path))
        expecteds.append(of_e)
        actuals.append(of_a)
        objects.append(both)
    return size


def _identities(records: list, fields: list[str]) -> list[str] | None:
    """The tuple of `fields` of each record; none unless each record has one of its own."""
    try:
        of_each = [[r[f] for f in fields] for r in records if type(r) is dict]
    except KeyError:
        return None
    if len(of_each) < len(records):
        return None
    out = [f"[{','.join(map(_dump, values))}]" for values in of_each]
    return out if len(set(out)) == len(out) else None


def _pairs(expected: str | None, actual: str | None, fields: list[str]) -> tuple[str, bool, list[tuple]]:
    """shape and unique of MET for one row's texts, and at, expected_pos, actual_pos and both values of each record."""
    e, a = _read(expected), _read(actual)
    kinds = [isinstance(v[0], list) for v in (e, a) if v]
    shape = "invalid_expected" if not e else "invalid_json" if not a else "array" if all(kinds) else "type" if any(kinds) else "single"
    if shape not in ("array", "single"):
        return shape, False, []
    sides = [v[0] if shape == "array" else [v[0]] for v in (e, a)]
    names = [_identities(side, fields) for side in sides] if shape == "array" and fields else [None]
    unique = None not in names
    if not unique:
        names = [[""] if shape == "single" else list(map(str, range(len(side)))) for side in sides]
    place, out = {name: i for i, name in enumerate(names[1])}, []
    for i, name in enumerate(names[0]):
        j = place.pop(name, None)
        out.append((name, i, j, sides[0][i], NOTHING if j is None else sides[1][j]))
    out += [(name, None, j, NOTHING, sides[1][j]) for name, j in place.items()]
    return shape, unique, out


def met_rows(df: DataFrame, kept: list[str], expected: str, actual: str, fields: str) -> DataFrame:
    """Rows `kept` and MET: the records of the JSON texts in two columns, those that match in one row.

    Both texts are of one row of `df`, so that their records meet there, without a
    shuffle. shape is array or single, or else which check failed: invalid_expected,
    invalid_json or type (an array against something else). A row without `at` stands for
    the texts themselves, which it has as its only member if a check failed. Records match
    by the tuple of the members named in `fields`, if each on both sides has one of its
    own (`unique`), and by position otherwise; that is `at`, empty for texts that are no
    arrays. members: the record under the empty path, and what is in objects of both
    sides, at any depth. Values are canonical; null where a side has none, and for
    objects on both sides. Arrays within are not entered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, members, held = [], ([], [], [], []), 0

            def flush() -> pa.RecordBatch:
                places, *own, ends = zip(*rows, strict=True)  # noqa: B023
                columns = [batch.column(k).take(pa.array(places, pa.int64())) for k in kept]  # noqa: B023
                columns += [pa.array(c, field.type) for c, field in zip(own, MET, strict=False)]
                of = [pa.array(c, field.type) for c, field in zip(members, MEMBER, strict=True)]
                columns.append(pa.ListArray.from_arrays(pa.array((0, *ends), pa.int32()), pa.StructArray.from_arrays(of, fields=list(MEMBER))))
                for c in (rows, *members):  # noqa: B023
                    c.clear()
                return pa.RecordBatch.from_arrays(columns, [*kept, *MET.names])

            given = [batch.column(c) for c in (expected, actual, fields)]
            for i in range(len(batch)):
                e, a, names = (c[i].as_py() for c in given)
                shape, unique, pairs = _pairs(e, a, names or [])
                if shape not in ("array", "single"):
                    for c, v in zip(members, ("", e, a, False), strict=True):
                        c.append(v)
                    held += len(e or "") + len(a or "")
                rows.append((i, shape, unique, None, None, None, len(members[0])))
                held += ROW
                for at, e_pos, a_pos, e, a in pairs:
                    held += _meet(e, a, members) + ROW
                    rows.append((i, shape, unique, at, e_pos, a_pos, len(members[0])))
                    if held >= PIECE:
                        yield flush()
                        held = 0
                if held >= PIECE:
                    yield flush()
                    held = 0
            if rows:
                yield flush()

    member = "struct<path:string,expected:string,actual:string,objects:boolean>"
    return df.mapInArrow(run, f"{_fields(df, kept)}, shape string, unique boolean, at string, expected_pos int, actual_pos int, members array<{member}>")
