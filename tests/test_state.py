"""State, patterns, catalogs, maintenance and readers."""

import json
import struct
import zipfile
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import (
    AutoSource, DatasetSpec, DeltaSource, FilesSource, FileStreamCheckpoint, IncrementalAggregate, JobState, LatestByKey, LocalCatalog, Measure, SeenKeys, TumblingWindow, UnsupportedFormatError, WatermarkGate,
    cleanup_checkpoint, inspect_checkpoint, read_files, reset_checkpoint_schema, reset_checkpoint_start_offset, truncate_checkpoint, write_parquet_batch,
)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def times(spark, *data):
    return spark.createDataFrame(list(data), "id bigint, t string").select("id", F.col("t").cast("timestamp_ntz").alias("t"))


def test_json_and_parquet(spark, tmp_path):
    state = JobState(tmp_path)
    assert state.load_json("a", 5) == 5 and state.load_parquet("a") is None and not state.exists("a")
    state.save_json("a", {"x": 1})
    state.save_json("a", {"x": 2})
    state.save_parquet("a", spark.range(2))
    state.save_parquet("a", state.load_parquet("a").union(spark.range(1)))
    assert state.load_json("a") == {"x": 2} and state.load_parquet("a").count() == 3
    assert state.exists("a", kind="json") and state.delete("a", kind="json") and not state.exists("a", kind="json")
    assert state.exists("a") and state.delete("a") and not state.delete("a")
    for bad in (lambda: state.exists("a", kind="csv"), lambda: state.delete("a", kind="csv"), lambda: state.save_json("../a", 1)):
        with pytest.raises(ValueError):
            bad()


def test_a_batch_run_again_counts_once(spark, tmp_path):
    total = IncrementalAggregate("t", ["k"], [Measure("n", "count"), Measure("s", "sum", "v")])
    batches = [spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint"), spark.createDataFrame([("a", 5)], "k string, v bigint")]
    for batch_id in (0, 0, 1, 1, 1):
        total.update(batches[batch_id], JobState(tmp_path).at(batch_id))
    assert rows(total.result(JobState(tmp_path))) == [("a", 2, 6), ("b", 1, 2)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.lists(st.tuples(st.sampled_from("abc"), st.integers(-9, 9) | st.none()), min_size=1, max_size=20), cuts=st.lists(st.integers(0, 20), max_size=2))
def test_any_split_equals_one_shot(spark, tmp_path_factory, data, cuts):
    measures = [Measure("n", "count", "v"), Measure("s", "sum", "v"), Measure("lo", "min", "v"), Measure("hi", "max", "v"), Measure("m", "avg", "v")]
    edges, root = sorted({0, len(data), *(min(c, len(data)) for c in cuts)}), tmp_path_factory.mktemp("state")
    total = IncrementalAggregate("t", ["k"], measures)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        total.update(spark.createDataFrame(data[a:b], "k string, v bigint"), JobState(root).at(i))
    whole = spark.createDataFrame(data, "k string, v bigint").groupBy("k").agg(F.count("v"), F.sum("v"), F.min("v"), F.max("v"), F.avg("v"))
    assert rows(total.result(JobState(root))) == rows(whole)


def test_distinct_sketch_and_window(spark, tmp_path):
    agg = IncrementalAggregate("t", [], [Measure("d", "approx_distinct", "id")])
    for i in range(3):
        agg.update(spark.range(i * 50, i * 50 + 100), JobState(tmp_path).at(i))
    assert abs(agg.result(JobState(tmp_path)).first()[0] - 200) < 10
    hourly = TumblingWindow.of("h", "t", "1 hour", [Measure("n", "count")])
    for i, t in enumerate(("2024-01-01 10:59:00", "2024-01-01 10:01:00", "2024-01-01 11:00:00")):
        hourly.update(times(spark, (i, t)), JobState(tmp_path).at(i))
    assert [(str(r[0]), r[1]) for r in hourly.result(JobState(tmp_path)).orderBy("window_start").collect()] == [("2024-01-01 10:00:00", 2), ("2024-01-01 11:00:00", 1)]
    with pytest.raises(ValueError):
        Measure("x", "median")


def test_watermark(spark, tmp_path):
    gate, day = WatermarkGate("wm", "t", "5 minutes"), "2024-01-01 "
    first = times(spark, (1, day + "10:00:00"), (2, day + "10:03:00"), (3, day + "10:05:00"))
    second = times(spark, (4, day + "10:02:00"), (5, day + "09:40:00"), (6, day + "10:08:00"), (7, None))
    assert len(rows(gate.split(first, JobState(tmp_path).at(0))[0])) == 3
    for _ in range(2):  # also when run again
        kept, late = gate.split(second, JobState(tmp_path).at(1))
        assert ([r[0] for r in rows(kept)], [r[0] for r in rows(late)]) == ([4, 6], [5, 7])
    assert JobState(tmp_path).load_json("wm") == day + "10:08:00"


def test_seen_and_latest(spark, tmp_path):
    schema = "event_id bigint, user_id bigint, value bigint, t bigint"
    one = spark.createDataFrame([(1, 101, 10, 1), (1, 101, 11, 2), (2, 102, 20, 1), (3, 103, 30, 1)], schema)
    two = spark.createDataFrame([(3, 103, 31, 0), (4, 104, 40, 5), (5, 105, 50, 5), (5, 105, 51, 6)], schema)
    seen, last = SeenKeys("s", ["event_id"], ["t"]), LatestByKey("l", ["user_id"], ["t"])
    got = [rows(seen.fresh(df, JobState(tmp_path).at(i)).select("event_id", "value")) for i, df in enumerate((one, two))]
    assert got == [[(1, 11), (2, 20), (3, 30)], [(4, 40), (5, 51)]]
    for i, df in enumerate((one, two)):
        last.update(df, JobState(tmp_path).at(i))
    assert rows(JobState(tmp_path).load_parquet("l").select("user_id", "value")) == [(101, 11), (102, 20), (103, 30), (104, 40), (105, 51)]


def test_seen_keys_expire(spark, tmp_path):
    seen = SeenKeys("s", ["id"], ["t"], expire=("t", "1 hour"))
    for i, (key, t) in enumerate(((1, "10:00"), (2, "12:00"), (1, "12:30"), (2, "12:40"))):
        fresh = rows(seen.fresh(times(spark, (key, f"2024-01-01 {t}:00")), JobState(tmp_path).at(i)))
        assert len(fresh) == (0 if i == 3 else 1)


def test_seen_keys_are_added_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.streaming.state.MANY_PARTS", 2)
    seen, folder = SeenKeys("s", ["id"], ["t"]), tmp_path / "s.parts"
    batch = lambda i: spark.createDataFrame([(None, 0)] + [(k, 0) for k in range(i, 2 * i + 2)], f"id {'int' if i < 3 else 'bigint'}, t int")
    known = set()
    for i in range(8):
        want = sorted({*range(i, 2 * i + 2), *([None] if i == 0 else [])} - known, key=str)
        for _ in range(2):  # a batch that runs again finds the same
            fresh = seen.fresh(batch(i), JobState(tmp_path).at(i))
            assert sorted((r.id for r in fresh.collect()), key=str) == want
        known |= set(want)
    state = JobState(tmp_path)
    assert sorted((r.id for r in state.load_parts("s").collect()), key=str) == sorted(known, key=str)  # each key once
    assert len(state._parts("s")) <= 4 and len(list(folder.glob("base*"))) == 2
    assert state.exists("s", kind="parts") and state.delete("s") and state.load_parts("s") is None


def test_catalog_entries():
    catalog = LocalCatalog({"a": {"format": "", "type": "csv", "path": None, "location": "/d", "options": {"x": 1, "y": 1}, "x": 2}, "bad": 3})
    assert catalog.resolve("a") == DatasetSpec("a", "csv", "/d", {"x": 2, "y": 1})  # a faulty entry does not keep others from use


def test_catalog(tmp_path):
    data = {"datasets": {"e": {"type": "parquet", "location": "/d", "options": {"recursive": True, "max_files_per_trigger": 2}, "max_files_per_trigger": 3}, "t": {"format": "delta", "path": "/t", "schema_mode": "coerce"}, "a": {"format": "auto", "path": "/a"}, "x": {"format": "xlsx", "path": "/x"}}}
    (tmp_path / "c.json").write_text(json.dumps(data))
    (tmp_path / "c.toml").write_text('[e]\nformat = "csv"\npath = "/d"\n')
    catalog = LocalCatalog(tmp_path / "c.json")
    assert catalog.get_source("e") == FilesSource("/d", file_format="parquet", recursive=True, max_files_per_trigger=3)
    assert isinstance(catalog.get_source("t"), DeltaSource) and catalog.resolve("t").to_schema_evolution().mode == "coerce"
    assert isinstance(catalog.get_source("a"), AutoSource) and catalog.get_source("x").file_format == "excel"
    assert LocalCatalog(tmp_path / "c.toml").get_source("e").file_format == "csv"
    with pytest.raises(KeyError):
        catalog.resolve("nope")
    with pytest.raises(UnsupportedFormatError):
        DatasetSpec("n", "orc", "/x").to_source()
    for bad in ({"datasets": [1]}, {"n": {"path": "/x"}}, {"n": {"format": "csv"}}, {"n": 3}, {"n": {"format": "csv", "path": "/x", "options": 3}}):
        with pytest.raises(ValueError):
            LocalCatalog(bad).resolve("n")
    with pytest.raises(ValueError):
        LocalCatalog(tmp_path / "c.yaml")


def batches(tmp_path, n=4):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(n):
        (folder / f"{i}.parquet").write_bytes(b"x")
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    while (batch := checkpoint.plan_batch(folder, max_files=1, start_timestamp=1)) is not None:
        checkpoint.write_offset(batch)
        checkpoint.write_commit(batch)
    return folder, tmp_path / "cp"


def test_cleanup_keeps_what_was_read(tmp_path):
    folder, cp = batches(tmp_path)
    assert cleanup_checkpoint(cp, keep_last_n=1, dry_run=True).removed_offsets == 3
    assert inspect_checkpoint(cp).offsets == 4
    assert cleanup_checkpoint(cp, older_than_seconds=3600).removed_commits == 0
    done = cleanup_checkpoint(cp, keep_last_n=2)
    assert (done.removed_offsets, done.removed_commits, done.kept_offsets, done.kept_commits) == (2, 2, 2, 2)
    assert cleanup_checkpoint(cp, keep_last_n=0).kept_commits == 1
    assert FileStreamCheckpoint(cp).plan_batch(folder) is None and FileStreamCheckpoint(cp).next_id() == 4
    for bad in ({}, {"keep_last_n": -1}):
        with pytest.raises(ValueError):
            cleanup_checkpoint(cp, **bad)


def test_truncate_reads_again(tmp_path):
    folder, cp = batches(tmp_path)
    assert truncate_checkpoint(cp, keep_through_batch_id=1, dry_run=True).removed_offsets == 2
    assert truncate_checkpoint(cp, keep_through_batch_id=1).kept_commits == 2
    again = FileStreamCheckpoint(cp).plan_batch(folder)
    assert [f[-9:] for f in again.files] == ["2.parquet", "3.parquet"] and again.batch_id == 2


def test_resets_and_inspect(tmp_path):
    _, cp = batches(tmp_path, 1)
    FileStreamCheckpoint(cp).save_schema([{"name": "a", "type": "long"}])
    info = inspect_checkpoint(cp)
    assert (info.latest_commit, info.pending, info.start_offset["mode"], info.schema[0]["name"]) == (0, 0, "timestamp", "a")
    assert reset_checkpoint_start_offset(cp)["timestamp"] == 1 and reset_checkpoint_start_offset(cp) is None
    assert reset_checkpoint_schema(cp)[0]["name"] == "a" and reset_checkpoint_schema(cp) is None
    assert inspect_checkpoint(tmp_path / "none").offsets == 0


def test_parquet_sink_is_idempotent(spark, tmp_path):
    for _ in range(2):
        assert write_parquet_batch(spark.range(3), tmp_path, 0)["path"].endswith("batch_0.parquet")
    write_parquet_batch(spark.range(1), tmp_path, 1)
    assert spark.read.parquet(str(tmp_path / "batch_*.parquet")).count() == 4


def test_readers(spark, tmp_path):
    (tmp_path / "g[1].json").write_text('[{"a": 1},\n {"a": 2}]')
    assert rows(read_files([str(tmp_path / "g[1].json")], "json")) == [(1,), (2,)]
    (tmp_path / "x.csv").write_text("a,b\n1,x\n2,\n")
    assert rows(read_files([str(tmp_path / "x.csv")], "csv")) == [(1, "x"), (2, None)]
    (tmp_path / "x.ndjson").write_text('{"a": 1}\n{"a": 3}\n')
    assert rows(read_files([str(tmp_path / "x.ndjson")], "jsonl")) == [(1,), (3,)]
    assert read_files([], schema=spark.range(1).schema).columns == ["id"]
    with pytest.raises(UnsupportedFormatError):
        read_files(["x"], "orc")


def test_files_of_unlike_schemas(spark, tmp_path, monkeypatch):
    from tidemark.errors import SchemaEvolutionError
    from tidemark.sources import readers

    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.sql("SELECT 1.5D AS id, 'x' AS note").coalesce(1).write.parquet(str(tmp_path / "b"))
    files = [str(next((tmp_path / f).glob("*.parquet"))) for f in "ab"]
    for limit in (64, 0):  # footers read by the driver, or by tasks
        monkeypatch.setattr(readers, "FOOTERS", limit)
        assert rows(read_files(files, relaxed=True)) == [(0.0, None), (1.0, None), (1.5, "x")]
        with pytest.raises(SchemaEvolutionError):
            read_files(files)


def test_reader_order(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "b"))
    spark.range(100, 400).coalesce(1).write.parquet(str(tmp_path / "a"))
    files = [str(next((tmp_path / f).glob("*.parquet"))) for f in "ba"]
    got = [r.id for r in read_files(files, with_order=True).orderBy("__file", "__row").collect()]
    assert got == [*range(5), *range(100, 400)]


def _xlsx(path, cells):
    sheet = "".join("<row>" + "".join(cells_of) + "</row>" for cells_of in cells)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>name</t></si><si><t>day</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")


def test_excel(spark, tmp_path):
    head = ['<c r="A1" t="s"><v>0</v></c>', '<c r="B1" t="s"><v>1</v></c>', '<c r="C1" t="s"><v>2</v></c>']
    _xlsx(tmp_path / "a.xlsx", [head, ['<c r="A2"><v>7</v></c>', '<c r="B2" t="s"><v>3</v></c>', '<c r="C2" s="1"><v>45292.5</v></c>'], ['<c r="A3"><v>8</v></c>', '<c r="C3" s="1"><v>45293</v></c>']])
    got = rows(read_files([str(tmp_path / "a.xlsx")], "xlsx"))
    assert [(r[0], r[1], str(r[2])) for r in got] == [(7, "x", "2024-01-01 12:00:00"), (8, None, "2024-01-02 00:00:00")]
    with pytest.raises(UnsupportedFormatError):
        read_files([str(tmp_path / "a.xls")], "excel")


def _long(n):
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _text(s):
    return _long(len(s)) + s


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_avro(spark, tmp_path, codec):
    schema = {"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "d", "type": {"type": "int", "logicalType": "date"}}, {"name": "v", "type": {"type": "array", "items": "double"}}]}
    record = lambda i, s: _long(i) + (_long(0) if s is None else _long(1) + _text(s)) + _long(19723) + _long(1) + struct.pack("<d", i / 2) + _long(0)
    body = record(5, b"x") + record(-300, None)
    if codec == "deflate":
        packer = zlib.compressobj(wbits=-15)
        body = packer.compress(body) + packer.flush()
    sync = b"0123456789abcdef"
    meta = _long(2) + _text(b"avro.schema") + _text(json.dumps(schema).encode()) + _text(b"avro.codec") + _text(codec.encode()) + _long(0)
    (tmp_path / "a.avro").write_bytes(b"Obj\x01" + meta + sync + _long(2) + _text(body) + sync)
    got = rows(read_files([str(tmp_path / "a.avro")], "avro"))
    assert [(r[0], r[1], str(r[2]), r[3]) for r in got] == [(-300, None, "2024-01-01", [-150.0]), (5, "x", "2024-01-01", [2.5])]
