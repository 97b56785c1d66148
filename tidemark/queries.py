"""The registered queries of the engine, each with its equivalent in SQL.

Every query runs the engine on the whole table: batches are planned, read, written
and committed as in use.  ``events`` is split into four batches by order of
arrival, in which every seventh event comes late.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import LocalCatalog
from tidemark.fs import fs_for, is_local, local_path
from tidemark.maintenance import cleanup_checkpoint, inspect_checkpoint, optimize_delta_table, truncate_checkpoint, vacuum_delta_table
from tidemark.operators.cdc import apply_cdc
from tidemark.operators.incremental import IncrementalAggregate, LatestByKey, Measure, SeenKeys, TumblingWindow, WatermarkGate
from tidemark.operators.schema import SchemaEvolution
from tidemark.operators.union import diagonal, relaxed_union
from tidemark.session import scratch
from tidemark.sinks import apply_cdc_delta, write_delta, write_parquet_batch
from tidemark.sources import AutoSource, DeltaSource, FilesSource, read_cdf_batch, read_files
from tidemark.streaming import JobState, Pipeline
from tidemark.streaming.structured import deduplicated, run_available, stream_files, write_available
from tidemark.table import DeltaTable

BATCHES = 4
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}

B = """WITH n AS (SELECT count(*) AS n FROM events),
b AS (SELECT e.*, least(3, (event_id + CASE WHEN event_id % 7 = 0 THEN n // 10 ELSE 0 END) * 4 // n) AS batch FROM events e, n)"""
W = f"""{B}, m AS (SELECT batch, max(ts) AS mx FROM b GROUP BY batch),
w AS (SELECT batch, max(mx) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM m)"""


def query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql is not None:
            _ORACLE[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    n = events.count()
    late = F.when(F.col("event_id") % 7 == 0, n // 10).otherwise(0)
    place = F.expr("arrival * %d div %d" % (BATCHES, max(n, 1)))
    return events.withColumn("arrival", F.col("event_id") + late).withColumn("batch", F.least(F.lit(BATCHES - 1).cast("long"), place)).drop("arrival")


def event_files(spark: SparkSession, sf_dir: str, root: str, columns: dict[int, list] | None = None) -> str:
    """The events as one file a batch, in folders that sort by batch; ``columns`` gives a batch columns of its own."""
    source, rows = f"{root}/source", arrivals(spark, sf_dir)
    if columns is None:
        rows.repartition(BATCHES, "batch").write.partitionBy("batch").parquet(source)
    else:
        for batch in range(BATCHES):
            rows.filter(F.col("batch") == batch).select(*columns[batch]).coalesce(1).write.parquet(f"{source}/batch={batch}")
    return source


def run(source: Any, root: str, writer: Callable, transform: Callable | None = None, reader: Callable | None = None, name: str = "job", **options: Any) -> None:
    """All batches of a source."""
    Pipeline(source, f"{root}/{name}", reader or read_files, writer, transform, **options).run(once=False, sleep=0, max_idle_loops=1)


def batches_of(source: str, **options: Any) -> FilesSource:
    return FilesSource(source, file_format="parquet", recursive=True, max_files_per_trigger=1, **options)


def job_state(root: str, name: str = "job") -> JobState:
    return JobState(f"{local_path(root)}/{name}/state")


def sink(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(f"{target}/batch_*.parquet")


MONEY = "decimal(18,2)"


# ---- files, state and aggregates


@query("SELECT event_type, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM events GROUP BY event_type")
def incr_event_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of files, each merged into a cumulative group-by."""
    root = scratch(spark, "incr-event-agg")
    total = IncrementalAggregate("totals", ["event_type"], [Measure("n_events", "count"), Measure("total_value", "sum", F.col("value").cast(MONEY))])
    run(batches_of(event_files(spark, sf_dir, root)), root, lambda df, state: total.update(df, state) and None)
    return total.result(job_state(root)).withColumn("total_value", F.col("total_value").cast("double"))


@query("SELECT user_id, count(*) AS n_events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value FROM events WHERE event_type <> 'error' GROUP BY user_id")
def incr_user_rollup_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's SQL, rolled up with the state's by SQL."""
    root = scratch(spark, "incr-user-rollup")

    def transform(df):
        return spark.sql(f"SELECT user_id, count(*) AS n_events, sum(CAST(value AS {MONEY})) AS total_value FROM {{events}} WHERE event_type <> 'error' GROUP BY user_id", events=df)

    def writer(df, state):
        before = state.load_parquet("rollup")
        both = df if before is None else diagonal([before, df])
        state.save_parquet("rollup", spark.sql("SELECT user_id, CAST(sum(n_events) AS BIGINT) AS n_events, CAST(sum(total_value) AS DECIMAL(28,2)) AS total_value FROM {both} GROUP BY user_id", both=both))

    run(batches_of(event_files(spark, sf_dir, root)), root, writer, transform)
    return job_state(root).load_parquet("rollup").withColumn("total_value", F.col("total_value").cast("double"))


@query("SELECT user_id, min(value) AS low, max(value) AS high, count(value) AS n, CAST(max(ts) AS TIMESTAMP) AS last_seen FROM events GROUP BY user_id")
def incr_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest values merged across batches."""
    root = scratch(spark, "incr-min-max")
    agg = IncrementalAggregate("extent", ["user_id"], [Measure("low", "min", "value"), Measure("high", "max", "value"), Measure("n", "count", "value"), Measure("last_seen", "max", "ts")])
    run(batches_of(event_files(spark, sf_dir, root)), root, lambda df, state: agg.update(df, state) and None)
    return agg.result(job_state(root))


@query("SELECT event_id, user_id, event_type, ts FROM events")
def files_capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a batch, each written as a batch of its own."""
    root = scratch(spark, "files-capped")
    run(batches_of(event_files(spark, sf_dir, root)), root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id))
    return sink(spark, f"{root}/out").select("event_id", "user_id", "event_type", "ts")


@query(f"{B} SELECT event_id, event_type FROM b WHERE batch >= 2")
def start_timestamp_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only files modified from a time on, also in later runs."""
    root = scratch(spark, "start-timestamp")
    source = event_files(spark, sf_dir, root)
    for f in fs_for(source).list(local_path(source), "*.parquet", True):
        batch = int(f.path.split("batch=")[1].split("/")[0])
        if is_local(f.path):
            os.utime(f.path, (1000 + batch, 1000 + batch))
    run(batches_of(source, start_timestamp=1002), root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id))
    return sink(spark, f"{root}/out").select("event_id", "event_type")


@query(f"{B} SELECT event_id, event_type FROM events UNION ALL SELECT event_id, 'again' AS event_type FROM b WHERE batch = 1")
def overwrite_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file written anew is read again, the others are not."""
    root = scratch(spark, "overwrite")
    source = event_files(spark, sf_dir, root)
    writer = lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id)
    run(batches_of(source, allow_overwrites=True), root, writer)
    fs = fs_for(source)
    old = next(f.path for f in fs.list(local_path(source), "*.parquet", True) if "batch=1/" in f.path)
    spark.read.parquet(old).withColumn("event_type", F.lit("again")).coalesce(1).write.parquet(f"{root}/anew")
    fs.delete(old)
    fs.rename(fs.list(local_path(f"{root}/anew"), "*.parquet", False)[0].path, old)
    run(batches_of(source, allow_overwrites=True), root, writer)
    return sink(spark, f"{root}/out").select("event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n_events FROM events GROUP BY 1")
def tumbling_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts merged across batches."""
    root = scratch(spark, "tumbling")
    hourly = TumblingWindow.of("hourly", "ts", "1 hour", [Measure("n_events", "count")])
    run(batches_of(event_files(spark, sf_dir, root)), root, lambda df, state: hourly.update(df, state) and None)
    return hourly.result(job_state(root))


def _watermark(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    root = scratch(spark, "watermark")
    gate = WatermarkGate("watermark", "ts", "1 day")

    def writer(df, batch_id, state):
        for rows, name in zip(gate.split(df, state), ("accepted", "late"), strict=True):
            write_parquet_batch(rows.select("event_id", F.lit(batch_id).cast("long").alias("batch")), f"{root}/{name}", batch_id)

    run(batches_of(event_files(spark, sf_dir, root)), root, writer)
    return sink(spark, f"{root}/{'late' if late else 'accepted'}")


@query(f"{W} SELECT event_id, batch FROM b JOIN w USING (batch) WHERE wm IS NULL OR ts >= wm - INTERVAL 1 DAY")
def watermark_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows not more than a day behind the greatest time of earlier batches."""
    return _watermark(spark, sf_dir, False)


@query(f"{W} SELECT event_id, batch FROM b JOIN w USING (batch) WHERE ts < wm - INTERVAL 1 DAY")
def watermark_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are later than that, in a sink of their own."""
    return _watermark(spark, sf_dir, True)


@query(
    f"""{B}, k AS (SELECT *, CAST(ts AS DATE) AS d, min(batch) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) AS fb FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, d ORDER BY ts DESC, event_id DESC) AS rn FROM k WHERE batch = fb)
SELECT event_id, user_id, event_type, CAST(d AS VARCHAR) AS d FROM r WHERE rn = 1"""
)
def dedupe_across_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key in the first batch that has the key."""
    root = scratch(spark, "dedupe")
    seen = SeenKeys("seen", ["user_id", "event_type", "d"], ["ts", "event_id"])

    def writer(df, batch_id, state):
        rows = seen.fresh(df.withColumn("d", F.to_date("ts")), state)
        return write_parquet_batch(rows.select("event_id", "user_id", "event_type", F.col("d").cast("string").alias("d")), f"{root}/out", batch_id)

    run(batches_of(event_files(spark, sf_dir, root)), root, writer)
    return sink(spark, f"{root}/out")


@query("SELECT user_id, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each user's last event."""
    root = scratch(spark, "latest")
    last = LatestByKey("last", ["user_id"], ["ts", "event_id"])
    run(batches_of(event_files(spark, sf_dir, root)), root, lambda df, state: last.update(df, state) and None, lambda df: df.select("user_id", "event_id", "ts", "value"))
    return job_state(root).load_parquet("last")


# ---- schema rules


def _schema_run(spark: SparkSession, sf_dir: str, first: list, later: list, rules: SchemaEvolution, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    root = scratch(spark, "schema")
    source = event_files(spark, sf_dir, root, {b: first if b == 0 else later for b in range(BATCHES)})
    run(batches_of(source), root, lambda df, batch_id: write_parquet_batch(finish(df), f"{root}/out", batch_id), schema_evolution=rules)
    return sink(spark, f"{root}/out")


@query(f"{B} SELECT event_id, CASE WHEN batch > 0 THEN event_type END AS event_type FROM b")
def schema_add_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that later batches bring."""
    finish = lambda df: df if "event_type" in df.columns else df.withColumn("event_type", F.lit(None).cast("string"))
    return _schema_run(spark, sf_dir, ["event_id"], ["event_id", "event_type"], SchemaEvolution("add_new_columns"), finish)


@query(
    f"""{B} SELECT event_id, CASE WHEN batch > 0 AND event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS v,
CASE WHEN batch > 0 AND event_id % 5 = 0 THEN 'bad-' || event_id END AS rescued_v FROM b"""
)
def schema_coerce_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that do not fit the type are null, their text is rescued."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("bad-"), F.col("event_id"))).otherwise(F.col("event_id").cast("string")).alias("v")
    finish = lambda df: df.select("event_id", F.col("v").cast("string").alias("v"), (F.col("_rescued.v") if "_rescued" in df.columns else F.lit(None).cast("string")).alias("rescued_v"))
    return _schema_run(spark, sf_dir, ["event_id", F.col("event_id").alias("v")], ["event_id", text], SchemaEvolution("coerce", "column"), finish)


@query(f"{B} SELECT event_id, CASE WHEN batch = 0 THEN CAST(event_id AS DOUBLE) ELSE value END AS v FROM b")
def schema_widen_int_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer column that becomes a double."""
    return _schema_run(spark, sf_dir, ["event_id", F.col("event_id").alias("v")], ["event_id", F.col("value").alias("v")], SchemaEvolution("type_widen"), lambda df: df.withColumn("v", F.col("v").cast("double")))


@query(f"{B} SELECT event_id, CASE WHEN batch = 0 THEN CAST(event_id AS VARCHAR) ELSE event_type END AS v FROM b")
def schema_widen_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An integer column that becomes a string."""
    return _schema_run(spark, sf_dir, ["event_id", F.col("event_id").alias("v")], ["event_id", F.col("event_type").alias("v")], SchemaEvolution("type_widen"), lambda df: df.withColumn("v", F.col("v").cast("string")))


@query(f"{B} SELECT event_id, CASE WHEN batch = 0 THEN CAST(event_id AS DOUBLE) ELSE value END AS v, CASE WHEN batch > 0 THEN CAST(user_id AS VARCHAR) END AS user_id FROM b")
def mixed_files_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of unlike columns and types in one batch, united."""
    root = scratch(spark, "mixed")
    first, later = ["event_id", F.col("event_id").alias("v")], ["event_id", F.col("value").alias("v"), "user_id"]
    source = event_files(spark, sf_dir, root, {b: first if b == 0 else later for b in range(BATCHES)})
    run(FilesSource(source, recursive=True), root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id), reader=lambda files: read_files(files, relaxed=True))
    return sink(spark, f"{root}/out").withColumn("user_id", F.col("user_id").cast("string"))


@query("SELECT CAST(o_orderkey AS DOUBLE) AS k, o_orderpriority AS note FROM orders UNION ALL SELECT l_quantity AS k, NULL AS note FROM lineitem")
def union_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables in the type that holds both."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("note"))
    return relaxed_union([orders, table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("k"))])


# ---- change rows


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A target without the keys that end in 2, and changes: 0 deleted, 1 updated twice, 2 inserted, 12 inserted and deleted."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    key = F.col("o_orderkey")
    change = lambda df, kind, version, plus=0: df.select("o_orderkey", (F.col("o_totalprice") + plus).alias("o_totalprice"), F.lit(kind).alias("_change_type"), F.lit(version).cast("long").alias("_commit_version"))
    updated = rows.filter(key % 10 == 1)
    changes = change(rows.filter(key % 10 == 0), "delete", 2).union(change(updated, "update_postimage", 1, 1)).union(change(updated, "update_postimage", 2, 2)).union(change(rows.filter(key % 10 == 2), "insert", 1)).union(change(rows.filter(key % 100 == 12), "delete", 2))
    return rows.filter(key % 10 != 2), changes


_MERGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 100 <> 12"


@query(_MERGED)
def cdc_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest change of each key merged into a table."""
    target, changes = _orders(spark, sf_dir)
    return apply_cdc(changes, target, keys=["o_orderkey"])


@query(_MERGED)
def cdc_ts_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, ordered by commit timestamps."""
    target, changes = _orders(spark, sf_dir)
    return apply_cdc(changes.withColumn("_commit_timestamp", F.col("_commit_version") * 1000).drop("_commit_version"), target, keys=["o_orderkey"])


@query(_MERGED)
def cdc_map_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with codes for the change types."""
    target, changes = _orders(spark, sf_dir)
    coded = changes.withColumn("op", F.upper(F.substring("_change_type", 1, 1))).drop("_change_type")
    return apply_cdc(coded, target, keys=["o_orderkey"], change_type_col="op", change_type_map={"D": "delete", "U": "update", "I": "insert"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 >= 2 UNION ALL SELECT o_orderkey, o_totalprice + v FROM orders, (VALUES (1),(2)) t(v) WHERE o_orderkey % 10 = 1")
def cdc_no_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All upserts, not only the latest of a key."""
    target, changes = _orders(spark, sf_dir)
    return apply_cdc(changes, target, keys=["o_orderkey"], dedupe_by_latest_commit=False)


@query(
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 = 2 AND o_orderkey % 100 <> 12 UNION ALL SELECT o_orderkey, o_totalprice + v FROM orders, (VALUES (1),(2)) t(v) WHERE o_orderkey % 10 = 1"
)
def cdc_null_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All upserts without a target: deletes win."""
    return apply_cdc(_orders(spark, sf_dir)[1], None, keys=["o_orderkey"], dedupe_by_latest_commit=False)


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def cdc_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts appended, all other changes left out."""
    target, changes = _orders(spark, sf_dir)
    return apply_cdc(changes, target, keys=["o_orderkey"], mode="append_only")


# ---- tables


def _event_table(spark: SparkSession, sf_dir: str, root: str, partition_by: list[str] | None = None) -> str:
    """A table of the events, one version a batch."""
    path, rows = f"{root}/table", arrivals(spark, sf_dir)
    for batch in range(BATCHES):
        write_delta(rows.filter(F.col("batch") == batch).select("event_id", "event_type", "value").coalesce(2), path, partition_by=partition_by)
    return path


def _stream_table(spark: SparkSession, root: str, source: DeltaSource, reader: Callable | None = None) -> DataFrame:
    spec = source.to_spec().with_checkpoint(f"{root}/job")
    run(source, root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id), reader=reader or (lambda files, batch: spec.read_batch(batch)), skip_empty=True)
    return sink(spark, f"{root}/out")


@query("SELECT event_id, event_type, value FROM events")
def delta_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's snapshot, three files a batch."""
    root = scratch(spark, "delta-snapshot")
    return _stream_table(spark, root, DeltaSource(_event_table(spark, sf_dir, root), max_files_per_trigger=3))


@query(f"{B} SELECT event_id, event_type, value FROM b WHERE batch >= 2")
def delta_log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table's later versions added."""
    root = scratch(spark, "delta-tail")
    return _stream_table(spark, root, DeltaSource(_event_table(spark, sf_dir, root), starting_version=2, max_files_per_trigger=1))


@query("SELECT event_id, event_type, value FROM events")
def delta_partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table, streamed."""
    root = scratch(spark, "delta-partitioned")
    return _stream_table(spark, root, DeltaSource(_event_table(spark, sf_dir, root, ["event_type"]))).select("event_id", "event_type", "value")


@query(f"{B} SELECT event_id, 'insert' AS _change_type, CAST(batch AS BIGINT) AS _commit_version FROM b")
def delta_cdf_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of appends."""
    root = scratch(spark, "delta-feed")
    source = DeltaSource(_event_table(spark, sf_dir, root), starting_version=0, read_change_feed=True)
    return _stream_table(spark, root, source, lambda files, batch: read_cdf_batch(batch)).select("event_id", "_change_type", "_commit_version")


def _merged_table(spark: SparkSession, sf_dir: str, root: str) -> str:
    target, changes = _orders(spark, sf_dir)
    path = f"{root}/orders"
    write_delta(target, path)
    apply_cdc_delta(changes, path, keys=["o_orderkey"], change_feed=True)
    return path


@query(_MERGED)
def delta_cdc_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes merged into a table on disk."""
    return DeltaTable(spark, _merged_table(spark, sf_dir, scratch(spark, "delta-cdc"))).read()


@query(
    """SELECT o_orderkey, o_totalprice, 'delete' AS _change_type, CAST(1 AS BIGINT) AS _commit_version FROM orders WHERE o_orderkey % 10 = 0
UNION ALL SELECT o_orderkey, o_totalprice, 'update_preimage', 1 FROM orders WHERE o_orderkey % 10 = 1
UNION ALL SELECT o_orderkey, o_totalprice + 2, 'update_postimage', 1 FROM orders WHERE o_orderkey % 10 = 1
UNION ALL SELECT o_orderkey, o_totalprice, 'insert', 1 FROM orders WHERE o_orderkey % 10 = 2 AND o_orderkey % 100 <> 12"""
)
def delta_cdf_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of a merge."""
    root = scratch(spark, "delta-feed-merge")
    source = DeltaSource(_merged_table(spark, sf_dir, root), starting_version=1, read_change_feed=True)
    return _stream_table(spark, root, source, lambda files, batch: read_cdf_batch(batch)).select("o_orderkey", "o_totalprice", "_change_type", "_commit_version")


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 2")
def delta_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as it was before the merge."""
    return DeltaTable(spark, _merged_table(spark, sf_dir, scratch(spark, "delta-travel"))).read(0)


@query(f"{B} SELECT event_id, CASE WHEN batch > 0 THEN CAST(user_id AS VARCHAR) END AS user_id FROM b")
def delta_schema_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that gains a column."""
    path, rows = f"{scratch(spark, 'delta-schema')}/table", arrivals(spark, sf_dir)
    write_delta(rows.filter("batch = 0").select("event_id"), path)
    write_delta(rows.filter("batch > 0").select("event_id", "user_id"), path, schema_mode="merge")
    return DeltaTable(spark, path).read().withColumn("user_id", F.col("user_id").cast("string"))


@query("SELECT event_id, event_type, value FROM events")
def delta_compact_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction and vacuum change no row."""
    path = _event_table(spark, sf_dir, scratch(spark, "delta-compact"))
    optimize_delta_table(path)
    vacuum_delta_table(path, retention_hours=0, enforce_retention=False)
    return DeltaTable(spark, path).read()


@query("SELECT event_id, event_type, value FROM events")
def delta_zorder_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustering by z-order changes no row."""
    path = _event_table(spark, sf_dir, scratch(spark, "delta-zorder"))
    optimize_delta_table(path, mode="z_order", z_order_columns=["event_type", "value"])
    return DeltaTable(spark, path).read()


@query("SELECT true AS same_files, CAST(3 AS BIGINT) AS last_version")
def delta_bulk_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log replayed by Spark, against the driver's replay."""
    t = DeltaTable(spark, _event_table(spark, sf_dir, scratch(spark, "delta-bulk")))
    snap, replayed = t.snapshot(), t.log.active_files_frame(spark)
    known = spark.createDataFrame([(p,) for p in snap.files], "path string")
    differing = replayed.select("path").exceptAll(known).union(known.exceptAll(replayed.select("path")))
    return differing.agg((F.count("*") == 0).alias("same_files")).withColumn("last_version", F.lit(snap.version).cast("long"))


# ---- formats and catalogs


def _round_trip(spark: SparkSession, sf_dir: str, file_format: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    root = scratch(spark, f"format-{file_format}")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    write(rows, f"{root}/source")
    source = FilesSource(f"{root}/source", file_format=file_format, pattern="part-*")
    run(source, root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id), reader=lambda files: read_files(files, file_format))
    return sink(spark, f"{root}/out").select("event_id", "user_id", "event_type", "value")


_EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


@query("SELECT event_id, CAST(user_id AS BIGINT) AS user_id, event_type, value FROM events")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with a header, types inferred."""
    out = _round_trip(spark, sf_dir, "csv", lambda df, path: df.write.option("header", True).csv(path))
    return out.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type", "value")


@query(_EVENTS)
def ndjson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, one object a line."""
    return _round_trip(spark, sf_dir, "ndjson", lambda df, path: df.write.json(path))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents that are arrays of objects."""
    root = scratch(spark, "format-json")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    whole = rows.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    whole.coalesce(1).write.text(f"{root}/source")
    source = FilesSource(f"{root}/source", file_format="json", pattern="part-*")
    run(source, root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id), reader=lambda files: read_files(files, "json"))
    return sink(spark, f"{root}/out").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE value > 10 AND event_type = 'click'")
def catalog_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set by name, filtered and projected."""
    root = scratch(spark, "catalog")
    catalog = LocalCatalog({"datasets": {"events": {"type": "files", "location": event_files(spark, sf_dir, root), "file_format": "parquet", "options": {"recursive": True}}}})
    transform = lambda df: df.filter((F.col("value") > 10) & (F.col("event_type") == "click")).select("event_id", (F.col("value") * 2).alias("doubled"))
    run(catalog.get_source("events"), root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id), transform)
    return sink(spark, f"{root}/out")


@query("SELECT event_id, event_type, value FROM events")
def auto_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table found by its log."""
    root = scratch(spark, "auto")
    source = AutoSource(_event_table(spark, sf_dir, root))
    run(source, root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id))
    return sink(spark, f"{root}/out")


# ---- checkpoints


@query("SELECT * FROM (VALUES ('planned', 4), ('kept', 2), ('pending', 0), ('read again', 2)) t(fact, n)")
def checkpoint_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches counted, logs cleaned, and batches forgotten and run again."""
    root = scratch(spark, "maintenance")
    source = batches_of(event_files(spark, sf_dir, root))
    counted: list[int] = []
    writer = lambda df, batch_id: counted.append(batch_id)
    run(source, root, writer)
    planned = inspect_checkpoint(f"{root}/job").commits
    cleanup = cleanup_checkpoint(f"{root}/job", keep_last_n=2)
    pending = inspect_checkpoint(f"{root}/job").pending
    truncate_checkpoint(f"{root}/job", keep_through_batch_id=1)
    counted.clear()
    run(source, root, writer)
    return spark.createDataFrame([("planned", planned), ("kept", cleanup.kept_commits), ("pending", pending), ("read again", len(counted))], "fact string, n int")


# ---- Structured Streaming


@query("SELECT event_type, count(*) AS n_events FROM events GROUP BY event_type")
def stream_event_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cumulative group-by on micro-batches of Spark's own stream."""
    root = scratch(spark, "stream-agg")
    stream = stream_files(spark, f"{event_files(spark, sf_dir, root)}/batch=*", table(spark, sf_dir, "events").schema, max_files_per_trigger=1)
    total = IncrementalAggregate("totals", ["event_type"], [Measure("n_events", "count")])
    run_available(stream, f"{root}/job", lambda df, epoch, state: total.update(df, state) and None)
    return total.result(job_state(root))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of keys, remembered by Spark's stream state."""
    root = scratch(spark, "stream-dedupe")
    stream = stream_files(spark, f"{event_files(spark, sf_dir, root)}/batch=*", table(spark, sf_dir, "events").schema)
    write_available(deduplicated(stream, ["user_id", "event_type"], "ts", "10000 days"), f"{root}/job", f"{root}/out")
    return spark.read.parquet(f"{root}/out").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# ---- more of each


@query(f"{B} SELECT event_id, event_type FROM b WHERE batch >= 1")
def files_max_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only files not much older than the newest one."""
    root = scratch(spark, "max-age")
    source = event_files(spark, sf_dir, root)
    for f in fs_for(source).list(local_path(source), "*.parquet", True):
        if is_local(f.path):
            os.utime(f.path, (1000 + 10 * int(f.path.split("batch=")[1].split("/")[0]),) * 2)
    run(batches_of(source, max_file_age=20), root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id))
    return sink(spark, f"{root}/out").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events")
def files_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files moved to an archive once their batch is committed, and whole there."""
    root = scratch(spark, "archive")
    source = batches_of(event_files(spark, sf_dir, root), clean_source="archive", clean_source_archive_dir=f"{root}/archive")
    run(source, root, lambda df: None)
    return spark.read.parquet(f"{root}/archive").select("event_id", "event_type")


@query(f"{B} SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, CAST(max(ts) AS TIMESTAMP) AS newest FROM b GROUP BY ALL")
def state_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON state that each batch extends."""
    root = scratch(spark, "state-json")

    def writer(df, batch_id, state):
        row = df.agg(F.count("*").alias("n"), F.max("ts").cast("string").alias("newest")).first()
        state.save_json("log", [*state.load_json("log", []), [batch_id, row.n, row.newest]])

    run(batches_of(event_files(spark, sf_dir, root)), root, writer)
    held = job_state(root).load_json("log", [])
    return spark.createDataFrame([tuple(r) for r in held], "batch long, n long, newest string").withColumn("newest", F.col("newest").cast("timestamp_ntz"))


@query("SELECT * FROM (VALUES ('commit', 4), ('plan', 5), ('reader', 4), ('transform', 4), ('writer', 4)) t(stage, ended)")
def observed_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages as an observer counts them."""
    root, ended = scratch(spark, "observer"), {}

    class Counting:
        def on_stage_end(self, stage, batch_id, duration_s, metadata=None):
            ended[stage] = ended.get(stage, 0) + 1

        def __getattr__(self, name):
            return lambda *args: None

    run(batches_of(event_files(spark, sf_dir, root)), root, lambda df: None, lambda df: df, observer=Counting())
    return spark.createDataFrame(sorted(ended.items()), "stage string, ended int")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, user_id AS k, event_type AS note FROM events UNION ALL SELECT NULL AS event_id, c_custkey AS k, NULL AS note FROM customer")
def union_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of frames with unlike columns of like types."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), F.col("event_type").alias("note"))
    out = diagonal([events, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))])
    return out.withColumn("event_id", F.col("event_id").cast("string"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS event_type, CASE WHEN event_type NOT IN ('click', 'view') THEN event_type END AS rescued FROM events")
def schema_enum_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside of an enumeration are rescued."""
    rules = SchemaEvolution("coerce", "column", schema={"event_id": "Int64", "event_type": "Enum(categories=['click', 'view'])"})
    out = rules.apply(table(spark, sf_dir, "events").select("event_type", "event_id"))
    return out.select("event_id", "event_type", F.col("_rescued.event_type").alias("rescued"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def cdc_ignore_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that leaves deletes out."""
    target, changes = _orders(spark, sf_dir)
    return apply_cdc(changes, target, keys=["o_orderkey"], ignore_delete=True)


@query("SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def cdc_append_only_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts appended to a table on disk, without rewriting it."""
    path = f"{scratch(spark, 'cdc-append')}/orders"
    target, changes = _orders(spark, sf_dir)
    write_delta(target, path)
    apply_cdc_delta(changes, path, keys=["o_orderkey"], mode="append_only")
    return DeltaTable(spark, path).read()


@query(
    """SELECT o_orderkey, count(*) AS versions FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 2 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 AND o_orderkey % 100 <> 12 AND o_orderkey % 10 IN (1, 2))
GROUP BY o_orderkey HAVING count(*) > 1 OR o_orderkey % 10 = 2"""
)
def delta_ignore_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that reads what a merge writes anew: keys seen twice, or only by the merge."""
    root = scratch(spark, "ignore-changes")
    target, changes = _orders(spark, sf_dir)
    path, key = f"{root}/orders", F.col("o_orderkey")
    write_delta(target.filter(key % 10 == 1).coalesce(1), path)
    write_delta(target.filter(key % 10 == 0).coalesce(1), path)
    write_delta(target.filter(key % 10 > 2).coalesce(1), path)
    apply_cdc_delta(changes, path, keys=["o_orderkey"])
    rows = _stream_table(spark, root, DeltaSource(path, starting_version=0, ignore_changes=True))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("versions")).filter((F.col("versions") > 1) | (key % 10 == 2))


@query("SELECT event_type, CAST(event_id AS VARCHAR) AS event_id FROM events")
def delta_overwrite_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose rows and columns are replaced."""
    path, events = f"{scratch(spark, 'delta-overwrite')}/table", table(spark, sf_dir, "events")
    write_delta(events.select("event_id", "value"), path)
    write_delta(events.select("event_type", F.col("event_id").cast("string").alias("event_id")), path, mode="overwrite", schema_mode="overwrite")
    return DeltaTable(spark, path).read()


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def excel_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook, read in batches as any file."""
    root = scratch(spark, "excel")
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()
    fs_for(root).write(local_path(f"{root}/source/region.xlsx"), _workbook(["r_regionkey", "r_name"], [tuple(r) for r in rows]))
    run(FilesSource(f"{root}/source", file_format="xlsx"), root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id), reader=lambda files: read_files(files, "excel"))
    return sink(spark, f"{root}/out")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def avro_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Avro container files."""
    root = scratch(spark, "avro")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()
    fs_for(root).write(local_path(f"{root}/source/nation.avro"), _container([tuple(r) for r in rows]))
    run(FilesSource(f"{root}/source", file_format="avro"), root, lambda df, batch_id: write_parquet_batch(df, f"{root}/out", batch_id), reader=lambda files: read_files(files, "avro"))
    return sink(spark, f"{root}/out")


def _workbook(names: list[str], rows: list[tuple]) -> bytes:
    """A small workbook, to be read back."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org"
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(names), *rows])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}/officeDocument/2006/relationships"><sheets><sheet name="s" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


def _container(rows: list[tuple[int, str]]) -> bytes:
    """A small Avro file of (n_nationkey, n_name), to be read back."""

    def long(n: int) -> bytes:
        n, out = (n << 1) ^ (n >> 63), b""
        while n > 0x7F:
            out += bytes([n & 0x7F | 0x80])
            n >>= 7
        return out + bytes([n])

    text = lambda s: long(len(s)) + s
    schema = b'{"type": "record", "name": "nation", "fields": [{"name": "n_nationkey", "type": "long"}, {"name": "n_name", "type": ["null", "string"]}]}'
    body = b"".join(long(k) + long(1) + text(n.encode()) for k, n in rows)
    mark = bytes(range(16))
    return b"Obj\x01" + long(1) + text(b"avro.schema") + text(schema) + long(0) + mark + long(len(rows)) + text(body) + mark
