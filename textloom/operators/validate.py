"""JSON Schema validation as Spark expressions.

A schema is compiled, once and on the driver, to a Column over a VARIANT that
lists its violations; Spark then evaluates it without leaving the JVM. Arrays and
additional properties become higher-order functions, so that depth is the
schema's, not the data's.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.json import elements, is_kind, member, members, once, with_json

TYPES = ("object", "array", "string", "number", "integer", "boolean", "null")
#: Keywords that say nothing about validity.
ANNOTATIONS = frozenset("$schema $id $anchor $comment $defs definitions title description default examples deprecated readOnly writeOnly format contentEncoding contentMediaType".split())
#: Keywords of the specification that are not implemented; a schema that uses one is refused.
REFUSED = frozenset("dependencies unevaluatedItems unevaluatedProperties $dynamicRef $recursiveRef additionalItems".split())
VIOLATIONS = "array<struct<path:string,keyword:string>>"

#: The smallest and largest difference from a whole number that multipleOf takes for none.
EPSILON = 1e-9


def _none() -> Column:
    return F.array().cast(VIOLATIONS)


def _one(path: Column, keyword: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"))).cast(VIOLATIONS)


def _unless(good: Column, path: Column, keyword: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), _none()).otherwise(_one(path, keyword))


def _check(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(f"invalid schema: {message}")


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _is(value: Column, name: str) -> Column:
    if name == "integer":
        return is_kind(value, "number") & (_number(value) == F.rint(_number(value)))
    return is_kind(value, name)


def _equals(value: Column, wanted: object) -> Column:
    if wanted is None:
        return is_kind(value, "null")
    if isinstance(wanted, bool):
        return is_kind(value, "boolean") & (F.try_variant_get(value, "$", "boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return is_kind(value, "number") & (_number(value) == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return is_kind(value, "string") & (F.try_variant_get(value, "$", "string") == F.lit(wanted))
    # both sides in the form that to_json gives a VARIANT
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _resolve(ref: str, root: object) -> object:
    _check(isinstance(ref, str) and ref.startswith("#"), f"$ref {ref!r} is not local")
    at = root
    for step in [s for s in ref[1:].split("/") if s]:
        step = step.replace("~1", "/").replace("~0", "~")
        at = at.get(step) if isinstance(at, dict) else at[int(step)] if isinstance(at, list) and step.isdigit() and int(step) < len(at) else None
    _check(isinstance(at, (dict, bool)), f"$ref {ref!r} leads nowhere")
    return at


def violations(value: Column, schema: object, path: Column | None = None, root: object = None, within: tuple[str, ...] = ()) -> Column:
    """Array of structs path, keyword: what `schema` finds wrong with a non-null VARIANT; empty if it is valid.

    Paths have a dot before each member name or array position; the root's is
    empty. Raises ValueError for a malformed schema, a keyword of the
    specification that is not implemented, and a recursive $ref. Keywords that the
    specification doesn't know are ignored.
    """
    path = F.lit("") if path is None else path
    root = schema if root is None else root
    if isinstance(schema, bool):
        return _none() if schema else _one(path, "false")
    _check(isinstance(schema, dict), "neither an object nor a boolean")
    if refused := REFUSED & schema.keys():
        raise ValueError(f"unsupported schema keyword: {', '.join(sorted(refused))}")
    below = lambda v, s, p: violations(v, s, p, root, within)
    found: list[Column] = []

    if "$ref" in schema:
        ref = schema["$ref"]
        _check(ref not in within, f"$ref {ref!r} is recursive")
        found.append(violations(value, _resolve(ref, root), path, root, (*within, ref)))
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        _check(bool(names) and all(n in TYPES for n in names), f"unknown type {schema['type']!r}")
        good = _is(value, names[0])
        for n in names[1:]:
            good = good | _is(value, n)
        found.append(_unless(good, path, "type"))
    if "enum" in schema:
        _check(isinstance(schema["enum"], list), "enum is not a list")
        good = F.lit(False)
        for x in schema["enum"]:
            good = good | _equals(value, x)
        found.append(_unless(good, path, "enum"))
    if "const" in schema:
        found.append(_unless(_equals(value, schema["const"]), path, "const"))
    found += _of_strings(value, schema, path) + _of_numbers(value, schema, path)
    found += _of_objects(value, schema, path, below) + _of_arrays(value, schema, path, below)
    for keyword in ("allOf", "anyOf", "oneOf"):
        if keyword in schema:
            _check(isinstance(schema[keyword], list) and bool(schema[keyword]), f"{keyword} is not a list of schemas")
            parts = [below(value, s, path) for s in schema[keyword]]
            if keyword == "allOf":
                found += parts
                continue
            n_good = sum((F.when(F.size(p) == 0, 1).otherwise(0) for p in parts), F.lit(0))
            found.append(_unless(n_good >= 1 if keyword == "anyOf" else n_good == 1, path, keyword))
    if "not" in schema:
        found.append(_unless(F.size(below(value, schema["not"], path)) > 0, path, "not"))
    if "if" in schema and ("then" in schema or "else" in schema):
        # without an `if` the other two say nothing, nor does it without them
        met = F.size(below(value, schema["if"], path)) == 0
        found.append(F.when(met, below(value, schema.get("then", True), path)).otherwise(below(value, schema.get("else", True), path)))
    return F.concat(*found) if len(found) > 1 else found[0] if found else _none()


def _limits(schema: dict, value: Column, applies: Column, path: Column, sizes: dict) -> list[Column]:
    """Violations of keywords that compare a size; `sizes`: keyword -> (column, comparison)."""
    out = []
    for keyword, (size, good) in sizes.items():
        if keyword in schema:
            limit = schema[keyword]
            _check(isinstance(limit, (int, float)) and not isinstance(limit, bool), f"{keyword} is not a number")
            out.append(F.when(applies, _unless(good(size, limit), path, keyword)).otherwise(_none()))
    return out


def _of_strings(value: Column, schema: dict, path: Column) -> list[Column]:
    is_string, text = is_kind(value, "string"), F.try_variant_get(value, "$", "string")
    length = F.char_length(text)
    out = _limits(schema, value, is_string, path, {"minLength": (length, lambda n, x: n >= x), "maxLength": (length, lambda n, x: n <= x)})
    if "pattern" in schema:
        _check(isinstance(schema["pattern"], str), "pattern is not a string")
        out.append(F.when(is_string, _unless(text.rlike(schema["pattern"]), path, "pattern")).otherwise(_none()))
    return out


def _of_numbers(value: Column, schema: dict, path: Column) -> list[Column]:
    n = _number(value)
    return _limits(
        schema, value, is_kind(value, "number"), path,
        {
            "minimum": (n, lambda n, x: n >= x), "maximum": (n, lambda n, x: n <= x),
            "exclusiveMinimum": (n, lambda n, x: n > x), "exclusiveMaximum": (n, lambda n, x: n < x),
            "multipleOf": (n, lambda n, x: F.abs(n / F.lit(float(x)) - F.round(n / F.lit(float(x)))) < EPSILON),
        },
    )


def _of_objects(value: Column, schema: dict, path: Column, below) -> list[Column]:
    is_object, of = is_kind(value, "object"), members(value)
    named = schema.get("properties", {})
    _check(isinstance(named, dict), "properties is not an object")
    out = _limits(schema, value, is_object, path, {"minProperties": (F.size(of), lambda n, x: n >= x), "maxProperties": (F.size(of), lambda n, x: n <= x)})
    required = schema.get("required", [])
    _check(isinstance(required, list) and all(isinstance(x, str) for x in required), "required is not a list of names")
    for name in required:
        out.append(F.when(is_object, _unless(member(value, name).isNotNull(), path, "required")).otherwise(_none()))
    for name, s in sorted(named.items()):
        v = member(value, name)
        inner = below(v, s, F.concat(path, F.lit(f".{name}")))
        out.append(F.when(is_object & v.isNotNull(), inner).otherwise(_none()))
    patterns = schema.get("patternProperties", {})
    _check(isinstance(patterns, dict), "patternProperties is not an object")
    each_of = lambda entries, s: F.flatten(F.transform(entries, lambda e: below(e["value"], s, F.concat(path, F.lit("."), e["key"]))))
    for pattern, s in sorted(patterns.items()):
        fitting = F.map_entries(F.map_filter(of, lambda k, _: k.rlike(pattern)))  # noqa: B023
        out.append(F.when(is_object, each_of(fitting, s)).otherwise(_none()))
    others = schema.get("additionalProperties", True)
    if others is not True:
        known = F.array(*[F.lit(k) for k in named]).cast("array<string>")

        def is_extra(name: Column, _: Column) -> Column:
            extra = ~F.array_contains(known, name)
            for pattern in patterns:
                extra = extra & ~name.rlike(pattern)
            return extra

        extra = F.map_entries(F.map_filter(of, is_extra))
        if others is False:
            out.append(F.when(is_object, _unless(F.size(extra) == 0, path, "additionalProperties")).otherwise(_none()))
        else:
            out.append(F.when(is_object, each_of(extra, others)).otherwise(_none()))
    if "propertyNames" in schema:
        wrong = F.exists(F.map_keys(of), lambda k: F.size(below(k.cast("variant"), schema["propertyNames"], path)) > 0)
        out.append(F.when(is_object, _unless(~wrong, path, "propertyNames")).otherwise(_none()))
    for keyword in ("dependentRequired", "dependentSchemas"):
        given = schema.get(keyword, {})
        _check(isinstance(given, dict), f"{keyword} is not an object")
        for name, then in sorted(given.items()):
            if keyword == "dependentRequired":
                _check(isinstance(then, list) and all(isinstance(x, str) for x in then), "dependentRequired has no list of names")
                needed = [member(value, x).isNotNull() for x in then]
                inner = F.concat(*[_unless(has, path, keyword) for has in needed]) if needed else _none()
            else:
                inner = below(value, then, path)
            out.append(F.when(is_object & member(value, name).isNotNull(), inner).otherwise(_none()))
    return out


def _of_arrays(value: Column, schema: dict, path: Column, below) -> list[Column]:
    is_array, of = is_kind(value, "array"), elements(value)
    out = _limits(schema, value, is_array, path, {"minItems": (F.size(of), lambda n, x: n >= x), "maxItems": (F.size(of), lambda n, x: n <= x)})
    first = schema.get("prefixItems", [])
    _check(isinstance(first, list), "prefixItems is not a list")
    for i, s in enumerate(first):
        v = F.get(of, F.lit(i))
        out.append(F.when(is_array & (F.size(of) > i), below(v, s, F.concat(path, F.lit(f".{i}")))).otherwise(_none()))
    if (items := schema.get("items", True)) is not True:
        # slice() starts at 1
        rest = F.slice(of, len(first) + 1, F.greatest(F.lit(0), F.size(of) - len(first))) if first else of
        each = F.transform(rest, lambda v, i: below(v, items, F.concat(path, F.lit("."), (i + len(first)).cast("string"))))
        out.append(F.when(is_array, F.flatten(each)).otherwise(_none()))
    if "contains" in schema:
        n_fitting = F.size(F.filter(of, lambda v: F.size(below(v, schema["contains"], path)) == 0))
        least = "minContains" if "minContains" in schema else "contains"
        limits = {least: schema.get("minContains", 1), **{k: schema[k] for k in ("maxContains",) if k in schema}}
        sizes = {least: (n_fitting, lambda n, x: n >= x), "maxContains": (n_fitting, lambda n, x: n <= x)}
        out += _limits(limits, value, is_array, path, sizes)
    if schema.get("uniqueItems"):
        texts = F.transform(of, lambda v: F.to_json(v))
        out.append(F.when(is_array, _unless(F.size(F.array_distinct(texts)) == F.size(of), path, "uniqueItems")).otherwise(_none()))
    return out


def message(found: Column) -> Column:
    """One violation as a line, several as a bulleted list; null for none."""
    line = lambda v: F.concat(F.coalesce(F.nullif(F.ltrim(v["path"], F.lit(".")), F.lit("")), F.lit("(root)")), F.lit(": "), v["keyword"])
    lines = F.transform(found, line)
    return F.when(F.size(found) == 1, F.concat(F.lit("schema validation: "), F.get(lines, 0))).when(
        F.size(found) > 1, F.concat(F.lit("schema validation:\n- "), F.array_join(lines, "\n- "))
    )


def validate(df: DataFrame, text: str, schema: object) -> DataFrame:
    """`df` with value (the strictly parsed VARIANT of column `text`), violations and error.

    error is `invalid JSON` for a null text or one that isn't one JSON value, the
    violations' message for one that the schema refuses, else null. Columns of `df`
    called value, violations or error are replaced.
    """
    kept = [c for c in df.columns if c not in ("value", "violations", "error")]
    parsed = with_json(df, text, "_parsed").select(*kept, F.col("_parsed").alias("value"))
    found = F.when(F.col("value").isNotNull(), violations(F.col("value"), schema))
    checked = once(parsed, found, "violations")
    return checked.withColumn("error", F.when(F.col("value").isNull(), F.lit("invalid JSON")).otherwise(message(F.col("violations"))))


def _root_rules(schema: object, root: object) -> list[dict]:
    """The schemas that all hold for the root: itself, and those it names in allOf and $ref."""
    if not isinstance(schema, dict):
        return []
    more = [*schema.get("allOf", []), *([_resolve(schema["$ref"], root)] if "$ref" in schema else [])]
    return [schema, *[rule for s in more for rule in _root_rules(s, root)]]


def array_violations(items: DataFrame, schema: dict, canonical: str) -> DataFrame:
    """Rows keyword: constraints of the root array that the items of all chunks break together.

    Chunks are known to be valid one by one, so counts suffice: no item is gathered
    anywhere. `canonical` is a column of JSON that is equal for equal items. Looked at
    are minItems, maxItems, uniqueItems and maxContains, in allOf and $ref too; what
    else a root says holds for each chunk by itself.
    """
    rules = _root_rules(schema, schema)
    agg, broken = [F.count("*").alias("n"), F.count_distinct(canonical).alias("different")], []
    for i, rule in enumerate(rules):
        for keyword, wrong in (("minItems", lambda x: F.col("n") < x), ("maxItems", lambda x: F.col("n") > x)):
            if keyword in rule:
                broken.append((keyword, wrong(rule[keyword])))
        if "contains" in rule and "maxContains" in rule:
            fits = F.size(violations(F.try_parse_json(canonical), rule["contains"], root=schema)) == 0
            agg.append(F.count_if(fits).alias(f"fitting_{i}"))
            broken.append(("maxContains", F.col(f"fitting_{i}") > rule["maxContains"]))
    if any(rule.get("uniqueItems") for rule in rules):
        broken.append(("uniqueItems", F.col("different") < F.col("n")))
    else:
        agg.pop(1)
    found = F.array_distinct(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in broken]).cast("array<string>"), lambda k: k.isNotNull()))
    return items.agg(*agg).select(F.explode(found).alias("keyword"))
