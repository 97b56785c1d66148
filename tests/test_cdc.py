"""Change rows merged into frames and tables."""

import pytest
from pyspark.sql import functions as F

from tidemark import DeltaTable, apply_cdc, apply_cdc_delta, write_delta
from tidemark.operators.cdc import normalised

V = "id bigint, value bigint, _change_type string, _commit_version bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, data, schema=V):
    return spark.createDataFrame(data, schema).coalesce(1)


def base(spark, *data):
    return spark.createDataFrame(list(data), "id bigint, value bigint")


def test_merge(spark):
    changes = frame(spark, [(2, 25, "update_postimage", 1), (1, None, "delete", 1), (3, 30, "insert", 1)])
    assert rows(apply_cdc(changes, base(spark, (1, 10), (2, 20)), keys=["id"])) == [(2, 25), (3, 30)]


def test_latest_commit_wins(spark):
    changes = frame(spark, [(1, 99, "update_postimage", 1), (1, None, "delete", 2)])
    assert rows(apply_cdc(changes, base(spark, (1, 10)), keys="id")) == []
    back = frame(spark, [(1, None, "delete", 1), (1, 5, "insert", 2)])
    assert rows(apply_cdc(back, base(spark, (1, 10)), keys="id")) == [(1, 5)]


def test_arrival_order_without_commits(spark):
    changes = frame(spark, [(1, 99, "update_postimage"), (1, None, "delete")], "id bigint, value bigint, _change_type string")
    assert rows(apply_cdc(changes, base(spark, (1, 10)), keys=["id"])) == []


def test_order_by_timestamp_and_version_first(spark):
    kind = "id bigint, value bigint, _change_type string, _commit_timestamp bigint"
    changes = frame(spark, [(1, 11, "update_postimage", 200), (1, 10, "update_postimage", 100)], kind)
    assert rows(apply_cdc(changes, base(spark, (1, 5)), keys=["id"])) == [(1, 11)]
    both = changes.withColumn("_commit_version", -F.col("_commit_timestamp"))
    assert rows(apply_cdc(both, base(spark, (1, 5)), keys=["id"])) == [(1, 10)]


def test_map(spark):
    changes = frame(spark, [(2, 25, "U", 1), (1, None, "D", 2), (3, 30, "I", 3)])
    types = {"U": "update_postimage", "D": "delete", "I": "insert"}
    assert rows(apply_cdc(changes, base(spark, (1, 10), (2, 20)), keys=["id"], change_type_map=types)) == [(2, 25), (3, 30)]
    kept = normalised(frame(spark, [("I",), ("X",)], "_change_type string"), "_change_type", {"I": "insert"})
    assert rows(kept) == [("X",), ("insert",)]


def test_append_only(spark):
    changes = frame(spark, [(1, 10, "insert", 1), (1, 11, "insert", 2), (2, 20, "insert", 1), (3, 3, "update_postimage", 1), (4, 4, "delete", 1)])
    assert rows(apply_cdc(changes, base(spark, (9, 5)), keys=["id"], mode="append_only")) == [(1, 11), (2, 20), (9, 5)]


def test_no_changes(spark):
    assert rows(apply_cdc(frame(spark, []), base(spark, (1, 10)), keys=["id"])) == [(1, 10)]


def test_without_dedupe(spark):
    changes = frame(spark, [(1, 10, "insert", 0), (1, None, "delete", 1), (2, 20, "insert", 1)])
    assert rows(apply_cdc(changes, None, keys=["id"], dedupe_by_latest_commit=False)) == [(2, 20)]
    assert rows(apply_cdc(changes, base(spark, (1, 1)), keys=["id"], dedupe_by_latest_commit=False)) == [(1, 10), (2, 20)]


def test_null_keys_and_types(spark):
    changes = frame(spark, [(None, 1, "delete", 1), (2, 9, None, 5), (2, 8, "update", 1)])
    got = rows(apply_cdc(changes, base(spark, (None, 7), (2, 2)), keys=["id"]))
    assert got == [(2, 8), (None, 7)]  # null keys never match, null types have no effect


def test_unknown_types_compete(spark):
    changes = frame(spark, [(1, 5, "update", 1), (1, 6, "merge", 2)])
    assert rows(apply_cdc(changes, base(spark, (1, 1)), keys=["id"])) == [(1, 1)]


def test_ignore(spark):
    changes = frame(spark, [(1, None, "delete", 3), (2, 7, "update_preimage", 2)])
    assert rows(apply_cdc(changes, base(spark, (1, 1), (2, 2)), keys=["id"], ignore_delete=True)) == [(1, 1), (2, 2)]


def test_new_columns(spark):
    changes = spark.createDataFrame([(2, 1, "n", "insert")], "id bigint, value bigint, note string, _change_type string")
    assert rows(apply_cdc(changes, base(spark, (1, 1)), keys=["id"])) == [(1, 1, None), (2, 1, "n")]


def test_errors(spark):
    changes = frame(spark, [])
    for options in ({"keys": []}, {"keys": ["nope"]}, {"keys": ["id"], "change_type_col": "nope"}, {"keys": ["id"], "mode": "replace"}):
        with pytest.raises(ValueError):
            apply_cdc(changes, None, **options)


def test_sink(spark, tmp_path):
    path = tmp_path / "t"
    nothing = apply_cdc_delta(frame(spark, [(1, None, "delete", 1)]), path, keys=["id"], mode="append_only")
    assert nothing["action"] == "noop" and not path.exists()
    first = apply_cdc_delta(frame(spark, [(1, 10, "insert", 1), (2, 20, "insert", 1)]), path, keys=["id"])
    assert (first["action"], first["rows_in"], first["rows_out"]) == ("merge", 2, 2)
    second = apply_cdc_delta(frame(spark, [(1, 11, "update_postimage", 2), (2, None, "delete", 2)]), path, keys=["id"])
    assert second["change_types"] == ["delete", "update_postimage"]
    assert rows(DeltaTable(spark, path).read()) == [(1, 11)]
    third = apply_cdc_delta(frame(spark, [(1, 1, "update", 3), (5, 50, "insert", 3), (6, None, "delete", 3)]), path, keys=["id"], mode="append_only")
    assert (third["action"], third["rows_out"]) == ("append_only", 1)
    assert rows(DeltaTable(spark, path).read()) == [(1, 11), (5, 50)]


def test_sink_rewrites_only_touched_files(spark, tmp_path):
    path = tmp_path / "t"
    for lo in (0, 100, 200):
        write_delta(spark.range(lo, lo + 10).select(F.col("id"), F.lit(0).cast("bigint").alias("value")).coalesce(1), path)
    before = set(DeltaTable(spark, path).snapshot().files)
    done = apply_cdc_delta(frame(spark, [(105, 7, "update_postimage", 1)]), path, keys=["id"], change_feed=True)
    table = DeltaTable(spark, path)
    assert done["files_rewritten"] == 1 and len(before & set(table.snapshot().files)) == 2
    assert table.read().filter("value = 7").count() == 1 and table.read().count() == 30
    feed = rows(table.read_changes(3).select("id", "value", "_change_type", "_commit_version"))
    assert feed == [(105, 0, "update_preimage", 3), (105, 7, "update_postimage", 3)]


def test_change_feed_of_merges(spark, tmp_path):
    feeds = []
    for name, dedupe in (("a", True), ("b", False)):
        path = tmp_path / name
        write_delta(base(spark, (1, 10), (2, 20), (4, 40)), path)
        changes = frame(spark, [(1, 11, "update", 1), (2, None, "delete", 1), (3, 30, "insert", 1), (5, None, "delete", 1)])
        apply_cdc_delta(changes, path, keys=["id"], change_feed=True, dedupe_by_latest_commit=dedupe)
        feeds.append(rows(DeltaTable(spark, path).read_changes(1).select("id", "value", "_change_type")))
        assert rows(DeltaTable(spark, path).read()) == [(1, 11), (3, 30), (4, 40)]
    assert feeds[0] == feeds[1] == [(1, 10, "update_preimage"), (1, 11, "update_postimage"), (2, 20, "delete"), (3, 30, "insert")]
