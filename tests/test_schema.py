"""Schema rules."""

import pytest
from pyspark.sql import functions as F

from tidemark import FileStreamCheckpoint, SchemaEvolution, SchemaEvolutionError, SchemaPolicy
from tidemark.functions.logical import logical_name, parse_field, widened
from tidemark.operators.schema import evolve, schema_fields, stored
from tidemark.operators.union import diagonal, relaxed_union, vertical


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def checkpoint(tmp_path):
    return FileStreamCheckpoint(tmp_path)


def test_first_batch_is_stored(spark, checkpoint):
    df = spark.createDataFrame([(1, "x")], "a bigint, b string")
    assert SchemaEvolution("add_new_columns").apply(df, checkpoint) is df
    assert [f.simpleString() for f in schema_fields(checkpoint.schema())] == ["a:bigint", "b:string"]


@pytest.mark.parametrize(("mode", "data", "fails"), [("strict", "a bigint, b string", True), ("strict", "b string, a bigint", True), ("add_new_columns", "a bigint, b string", False)])
def test_new_column(spark, checkpoint, mode, data, fails):
    checkpoint.save_schema(stored(schema_fields({"a": "Int64"})))
    df = spark.createDataFrame([], data)
    if fails:
        with pytest.raises(SchemaEvolutionError):
            SchemaEvolution(mode).apply(df, checkpoint)
    else:
        assert SchemaEvolution(mode).apply(df, checkpoint).columns == ["a", "b"]
        assert [f.name for f in schema_fields(checkpoint.schema())] == ["a", "b"]


def test_missing_column(spark):
    fields = schema_fields([("a", "Int64"), ("b", "String")])
    df = spark.createDataFrame([(1,)], "a bigint")
    out, after = evolve(df, fields, SchemaPolicy("add_new_columns"))
    assert rows(out) == [(1, None)] and out.columns == ["a", "b"] and after == fields
    with pytest.raises(SchemaEvolutionError):
        evolve(df, fields, SchemaPolicy("strict"))


def test_strict_reorders(spark):
    df = spark.createDataFrame([("x", 1)], "b string, a bigint")
    assert evolve(df, schema_fields({"a": "bigint", "b": "string"}), SchemaPolicy("strict"))[0].columns == ["a", "b"]


def test_coerce_and_rescue(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    out, _ = evolve(df, schema_fields({"a": "Int64"}), SchemaPolicy("coerce", "column"))
    got = out.select("a", "_rescued.a").collect()
    assert [tuple(r) for r in got] == [(1, None), (None, "x"), (None, None)]


def test_rescue_only_where_types_differ(spark):
    df = spark.createDataFrame([(1, "2")], "a bigint, b string")
    out, _ = evolve(df, schema_fields({"a": "Int64", "b": "Int64"}), SchemaPolicy("coerce", "column"))
    assert out.select("_rescued.*").columns == ["b"]
    same, _ = evolve(df, schema_fields({"a": "Int64", "b": "String"}), SchemaPolicy("coerce", "column"))
    assert "_rescued" not in same.columns
    steady, _ = evolve(df, schema_fields({"a": "Int64", "b": "String"}), SchemaPolicy("coerce", "column"), stable_rescue=True)
    assert steady.select("_rescued.*").columns == ["a", "b"]


def test_impossible_cast_is_rescued(spark):
    df = spark.sql("SELECT DATE'2020-01-02' AS a")
    out, _ = evolve(df, schema_fields({"a": "Int64"}), SchemaPolicy("coerce", "column"))
    assert [tuple(r) for r in out.select("a", "_rescued.a").collect()] == [(None, "2020-01-02")]


def test_enum_values(spark):
    df = spark.createDataFrame([("a",), ("z",)], "c string")
    out, _ = evolve(df, schema_fields({"c": "Enum(categories=['a', 'b'])"}), SchemaPolicy("coerce", "column"))
    assert rows(out.select("c", "_rescued.c")) == [("a", None), (None, "z")]


@pytest.mark.parametrize(("kind", "value", "after"), [("double", 1.5, "double"), ("string", "1", "string"), ("int", 1, "bigint"), ("boolean", True, "bigint")])
def test_widen(spark, checkpoint, kind, value, after):
    checkpoint.save_schema(stored(schema_fields({"a": "Int64"})))
    out = SchemaEvolution("type_widen").apply(spark.createDataFrame([(value,)], f"a {kind}"), checkpoint)
    assert out.schema["a"].dataType.simpleString() == after
    assert schema_fields(checkpoint.schema())[0].dataType.simpleString() == after


def test_widen_over_three_batches(spark, checkpoint):
    rules = SchemaEvolution("type_widen")
    for kind, value, after in (("int", 1, "int"), ("bigint", 2, "bigint"), ("double", 2.5, "double"), ("int", 3, "double"), ("string", "x", "string")):
        out = rules.apply(spark.createDataFrame([(value,)], f"a {kind}"), checkpoint)
        assert out.schema["a"].dataType.simpleString() == after


def test_widen_without_rule(spark):
    with pytest.raises(SchemaEvolutionError):
        evolve(spark.createDataFrame([(1,)], "a bigint"), schema_fields({"a": "Date"}), SchemaPolicy("type_widen"))


@pytest.mark.parametrize(
    ("a", "b", "c"),
    [("Int32", "Int64", "Int64"), ("UInt8", "UInt16", "UInt16"), ("Int32", "UInt32", "Float64"), ("Float32", "Int64", "Float64"), ("Float32", "Float64", "Float64"), ("Utf8", "Int32", "String"),
     ("Boolean", "Int8", "Int8"), ("Boolean", "Float32", "Float64"), ("Boolean", "UInt8", "UInt8"), ("String", "Boolean", "String"), ("Date", "Int64", None), ("String", "Date", None), ("Boolean", "Boolean", "Boolean")],
)
def test_lattice(a, b, c):
    for x, y in ((a, b), (b, a)):
        out = widened(parse_field("x", x), parse_field("x", y))
        assert (out and logical_name(out)) == c


@pytest.mark.parametrize(
    ("text", "kind"),
    [("List(Int64)", "array<bigint>"), ("Struct({'a': Int64, 'b': String})", "struct<a:bigint,b:string>"), ("List(Struct({'a': Int64}))", "array<struct<a:bigint>>"), ("List(List(Int64))", "array<array<bigint>>"),
     ("Struct({'a': List(Int64), 'b': String})", "struct<a:array<bigint>,b:string>"), ("Datetime(time_unit='us', time_zone='UTC')", "timestamp"), ("Datetime(time_unit='ms', time_zone=None)", "timestamp_ntz"),
     ("Duration(time_unit='ns')", "interval day to second"), ("Decimal(10, 2)", "decimal(10,2)"), ("map<string,int>", "map<string,int>"), ("UInt64", "decimal(20,0)"), ("Time", "bigint")],
)
def test_type_names(spark, text, kind):
    assert parse_field("x", text).dataType.simpleString() == kind


def test_schema_round_trip(spark):
    fields = schema_fields({"a": "UInt16", "b": "List(Struct({'c': Date}))", "e": "Enum(categories=['x'])"})
    assert schema_fields(stored(fields)) == fields
    assert schema_fields([{"name": "a", "dtype": "Int8"}])[0].dataType.simpleString() == "tinyint"
    for bad in ([1], {"a": "no such type"}, [{"name": "a"}]):
        with pytest.raises(SchemaEvolutionError):
            schema_fields(bad)


def test_explicit_schema_outranks_stored(spark, checkpoint):
    checkpoint.save_schema(stored(schema_fields({"a": "String"})))
    out = SchemaEvolution("coerce", schema={"a": "Int64"}).apply(spark.createDataFrame([("7",)], "a string"), checkpoint)
    assert rows(out) == [(7,)]


def test_other_payloads_pass(checkpoint):
    payload = {"a": 1}
    assert SchemaEvolution("strict").apply(payload, checkpoint) is payload


def test_options():
    rules, rest = SchemaEvolution.from_options({"schema_mode": "coerce", "rescue_mode": "column", "path": "x"})
    assert (rules.mode, rules.rescue_mode, rest) == ("coerce", "column", {"path": "x"})
    assert SchemaEvolution.from_options({"path": "x"})[0] is None
    for bad in ({"mode": "loose"}, {"rescue_mode": "file"}):
        with pytest.raises(SchemaEvolutionError):
            SchemaEvolution(**bad)


def test_unions(spark):
    a, b = spark.createDataFrame([(1, "x")], "a bigint, b string"), spark.createDataFrame([(2,)], "a bigint")
    assert rows(diagonal([a, b])) == [(1, "x"), (2, None)]
    wrong = spark.createDataFrame([("2",)], "a string")
    for union in (diagonal, vertical):
        with pytest.raises(SchemaEvolutionError):
            union([a, wrong])
    with pytest.raises(SchemaEvolutionError):
        vertical([a, b])
    assert rows(relaxed_union([a, wrong])) == [("1", "x"), ("2", None)]
    with pytest.raises(SchemaEvolutionError):
        relaxed_union([a, spark.range(1).select(F.current_date().alias("a"))])
