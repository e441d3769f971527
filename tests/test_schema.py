"""Schemas and validation."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.json import last_key_wins
from textloom.operators.schema import DEFAULT_SCHEMA, choose_schema, fields_schema, has_array_root, prepare, spark_type
from textloom.operators.validate import array_violations, validate


def errors(spark, schema, texts):
    last_key_wins(spark)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    schema = schema if isinstance(schema, (dict, bool)) else prepare(schema).schema
    return [r["error"] for r in validate(rows, "text", schema).orderBy("i").collect()]


def accepts(spark, schema, good, bad):
    found = errors(spark, schema, [*good, *bad])
    assert [e is None for e in found] == [True] * len(good) + [False] * len(bad), list(zip([*good, *bad], found, strict=True))


def test_fields(spark):
    schema = fields_schema("name, age,email")
    one = '{"name":"A","age":"3","email":"e"}'
    accepts(spark, schema, [f"[{one}]", f"[{one},{one}]", "[]"], [f'[{one[:-1]},"x":"y"}}]', '[{"name":"A","age":"3"}]', one, '[{"name":"A","age":3,"email":"e"}]'])
    assert json.loads(schema)["items"]["required"] == ["name", "age", "email"]


@pytest.mark.parametrize("fields", ["", "  foo ,  bar  ,, ", "foo,bar,foo"])
def test_wrong_fields(fields):
    with pytest.raises(ValueError):
        fields_schema(fields)


def test_precedence():
    assert choose_schema("{}", "a") == "{}" and choose_schema() == DEFAULT_SCHEMA
    with pytest.raises(ValueError):
        choose_schema(fields="")


@pytest.mark.parametrize(
    "schema,array",
    [({"type": "array"}, True), ({"type": "object"}, False), ({"type": ["array", "null"]}, True), ({"type": ["object", "null"]}, False), ({}, False), ({"type": 42}, False), (True, False)],
)
def test_root(schema, array):
    assert has_array_root(schema) is array


def test_types(spark):
    schema = {"type": "object", "properties": {"str": {"type": "string"}, "num": {"type": "number"}, "bool": {"type": "boolean"}, "arr": {"type": "array", "items": {"type": "string"}}}, "required": ["str", "num", "bool", "arr"]}
    accepts(spark, schema, ['{"str":"hello","num":42,"bool":true,"arr":["a","b"]}', '{"str":"","num":4.5,"bool":false,"arr":[],"more":1}'], ['{"str":1,"num":"x","bool":"y","arr":"z"}', '{"str":"hello"}', '{"str":"hello","num":42,"bool":true,"arr":["a",1]}'])


def test_enum_const_null_and_integer(spark):
    accepts(spark, {"enum": ["red", "green", 3, None, True, {"a": [1]}]}, ['"red"', "3", "3.0", "null", "true", '{"a":[1]}'], ['"purple"', "1", "false", '{"a":[2]}'])
    accepts(spark, {"type": ["string", "null"]}, ['"hello"', "null"], ["42", "[]"])
    accepts(spark, {"const": "1.0"}, ['"1.0"'], ["1.0", '"1"'])
    accepts(spark, {"type": "integer"}, ["30", "30.0", "-5", "1e3", "12345678901234567890"], ["30.5", "true", '"30"', "null"])
    accepts(spark, {"type": "number"}, ["1", "1.5"], ["true"])


def test_objects_and_arrays(spark):
    accepts(spark, {"type": "object", "properties": {"name": {"type": "string"}}, "additionalProperties": {"type": "number"}}, ['{"name":"a","score":100}', "{}"], ['{"name":"a","score":"high"}'])
    accepts(spark, {"properties": {"tags": {"type": "array", "items": {"type": "string"}, "minItems": 1, "maxItems": 3}}}, ['{"tags":["a","b"]}', "{}", "5"], ['{"tags":[]}', '{"tags":["a","b","c","d"]}'])
    nested = {"type": "object", "properties": {"a": {"type": "object", "properties": {"b.c": {"type": "array", "items": {"type": "object", "required": ["d"]}}}, "required": ["b.c"]}}, "required": ["a"]}
    accepts(spark, nested, ['{"a":{"b.c":[{"d":null}]}}'], ['{"a":{"b.c":[{"e":1}]}}', '{"a":{}}', "{}"])
    accepts(spark, {"prefixItems": [{"type": "string"}, {"type": "number"}], "items": False}, ['["a",1]', '["a"]', "[]"], ['[1]', '["a",1,2]'])
    accepts(spark, {"uniqueItems": True}, ["[1,2]", "[]"], ["[1,1]", '[{"a":1,"b":2},{"b":2,"a":1}]'])
    accepts(spark, {"minProperties": 1, "maxProperties": 2}, ['{"a":1}', "7"], ["{}", '{"a":1,"b":2,"c":3}'])


def test_limits_and_combinations(spark):
    accepts(spark, {"minimum": 1, "exclusiveMaximum": 5, "multipleOf": 0.5}, ["1", "4.5", '"x"'], ["0", "5", "1.2"])
    accepts(spark, {"minLength": 2, "maxLength": 3, "pattern": "^a"}, ['"ab"', '"a😀"', "5"], ['"a"', '"abcd"', '"bc"'])
    accepts(spark, {"anyOf": [{"type": "string"}, {"minimum": 5}]}, ['"a"', "6"], ["4"])
    accepts(spark, {"oneOf": [{"type": "integer"}, {"minimum": 5}]}, ["4", "5.5"], ["6", "4.5"])
    accepts(spark, {"allOf": [{"type": "integer"}, {"minimum": 5}], "not": {"const": 7}}, ["6"], ["7", "4"])
    accepts(spark, {"$defs": {"n": {"type": "number"}}, "items": {"$ref": "#/$defs/n"}}, ["[1,2]"], ['["a"]'])
    accepts(spark, True, ["1", "{}"], ["x", ""])
    accepts(spark, False, [], ["1"])


def test_names_by_pattern(spark):
    named = {"properties": {"n1": {"minimum": 5}}, "patternProperties": {"^n": {"type": "integer"}, "x$": {"type": "string"}}, "additionalProperties": False}
    accepts(spark, named, ['{"n1":7,"n2":1,"ax":"t"}', "{}", "5"], ['{"n1":1}', '{"n2":"t"}', '{"nx":1}', '{"other":1}'])
    rest = {"patternProperties": {"^n": True}, "additionalProperties": {"type": "boolean"}}
    accepts(spark, rest, ['{"n":1,"a":true}'], ['{"n":1,"a":1}'])
    accepts(spark, {"propertyNames": {"pattern": "^[a-z]+$", "maxLength": 3}}, ['{"abc":1}', "{}", "[]"], ['{"abcd":1}', '{"A":1}'])
    assert errors(spark, named, ['{"n2":"t"}']) == ["schema validation: n2: type"]


def test_contains(spark):
    accepts(spark, {"contains": {"type": "string"}}, ['[1,"a"]', '"x"', "{}"], ["[]", "[1]"])
    accepts(spark, {"contains": {"minimum": 3}, "minContains": 2, "maxContains": 3}, ["[3,4,1]", "[3,4,5]"], ["[3]", "[3,3,3,3]", "[]"])
    accepts(spark, {"contains": {"type": "string"}, "minContains": 0}, ["[]", "[1]"], [])
    # without `contains` the bounds say nothing
    accepts(spark, {"minContains": 2}, ["[]"], [])


def test_conditions(spark):
    either = {"if": {"properties": {"kind": {"const": "a"}}, "required": ["kind"]}, "then": {"required": ["x"]}, "else": {"required": ["y"]}}
    accepts(spark, either, ['{"kind":"a","x":1}', '{"kind":"b","y":1}', '{"y":1}'], ['{"kind":"a","y":1}', '{"kind":"b","x":1}'])
    accepts(spark, {"if": {"type": "string"}, "then": {"minLength": 2}}, ['"ab"', "1"], ['"a"'])
    accepts(spark, {"then": False, "else": False}, ["1"], [])
    accepts(spark, {"dependentRequired": {"a": ["b", "c"], "d": []}}, ['{"a":1,"b":2,"c":null}', '{"b":1}', '{"d":1}', "1"], ['{"a":1}', '{"a":null,"b":1}'])
    accepts(spark, {"dependentSchemas": {"a": {"properties": {"b": {"type": "string"}}}}}, ['{"b":1}', '{"a":1,"b":"t"}'], ['{"a":1,"b":1}'])
    nested = {"items": {"if": {"required": ["a"]}, "then": {"patternProperties": {"^b": {"contains": {"const": 1}}}}}}
    accepts(spark, nested, ['[{"b":[2]}]', '[{"a":1,"b":[2,1]}]'], ['[{"a":1,"b":[2]}]'])


def test_messages(spark):
    schema = {"type": "array", "items": {"type": "object", "required": ["a"], "properties": {"b": {"type": "string"}}}}
    one, two, broken, root = errors(spark, schema, ['[{"a":1,"b":2}]', '[{"b":2},5]', "[", "{}"])
    assert one == "schema validation: 0.b: type"
    assert two == "schema validation:\n- 0: required\n- 0.b: type\n- 1: type" and broken == "invalid JSON" and root == "schema validation: (root): type"


@pytest.mark.parametrize("text", ["{", "[]", "5", '{"type":"text"}', '{"required":"a"}', '{"$ref":"#/nowhere"}', '{"$ref":"#"}', '{"unevaluatedItems":false}', '{"patternProperties":[]}', '{"dependentRequired":{"a":"b"}}', '{"minContains":"1","contains":true}', '{"anyOf":[]}', '{"minItems":"1"}'])
def test_malformed_schemas(spark, text):
    with pytest.raises(ValueError):
        prepare(text)


def test_unknown_keywords_are_ignored(spark):
    accepts(spark, {"x-note": 1, "title": "t", "type": "string"}, ['"a"'], ["1"])


def test_spark_types():
    item = prepare(fields_schema("b,a")).item
    assert spark_type(item) == T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])
    assert spark_type({"type": ["integer", "null"]}) == T.LongType()
    assert spark_type({"type": "object", "additionalProperties": {"type": "number"}}) == T.MapType(T.StringType(), T.DoubleType())
    assert spark_type({"type": ["string", "number"]}) == T.VariantType()
    assert spark_type({"enum": ["a"]}) == T.StringType()
    assert spark_type({"type": "object", "patternProperties": {"^n": {"type": "integer"}}, "additionalProperties": {"type": "string"}}) == T.VariantType()


def test_constraints_over_all_items(spark):
    items = spark.createDataFrame([("1",), ("2",), ("2",)], "c string")
    keywords = lambda s: {r["keyword"] for r in array_violations(items, s, "c").collect()}
    assert keywords({"minItems": 4, "uniqueItems": True}) == {"minItems", "uniqueItems"}
    assert keywords({"minItems": 3, "maxItems": 3}) == set() and keywords({"maxItems": 2}) == {"maxItems"}
    assert keywords({"contains": {"const": 2}, "maxContains": 1}) == {"maxContains"} and keywords({"contains": {"const": 2}, "maxContains": 2}) == set()
    within = {"$ref": "#/$defs/few", "allOf": [{"uniqueItems": True}], "$defs": {"few": {"maxItems": 2, "contains": {"$ref": "#/$defs/two"}, "maxContains": 1}, "two": {"const": 2}}}
    assert keywords(within) == {"maxItems", "uniqueItems", "maxContains"}


def test_clashing_columns_are_replaced(spark):
    rows = spark.createDataFrame([("[1]", 1.5, "x", "y"), ("{", None, None, None)], "j string, value double, violations string, error string")
    got = validate(rows, "j", {"type": "object"}).select("j", F.to_json("value").alias("v"), "error")
    assert got.dtypes == [("j", "string"), ("v", "string"), ("error", "string")]
    assert sorted(map(tuple, got.collect())) == [("[1]", "[1]", "schema validation: (root): type"), ("{", None, "invalid JSON")]
