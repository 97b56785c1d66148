"""The Structured Streaming forms."""

from pyspark.sql import functions as F

from tidemark.streaming.structured import deduplicated, run_available, sessions, stream_files, windowed, write_available


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def feed(spark, folder, name, *data):
    df = spark.createDataFrame(list(data), "k string, t string").select("k", F.col("t").cast("timestamp").alias("t"))
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    return df.schema


def test_windows_close_with_the_watermark(spark, tmp_path):
    day = "2024-01-01 "
    schema = feed(spark, tmp_path, "in/a", ("a", day + "10:01:00"), ("a", day + "10:59:00"), ("b", day + "11:01:00"))
    for every, slide, want in (("1 hour", None, [("10:00", 2), ("11:00", 1)]), ("1 hour", "30 minutes", [("09:30", 1), ("10:00", 2), ("10:30", 2), ("11:00", 1)])):
        target = f"{tmp_path}/out-{slide}"
        for name in ("a", "b"):
            if name == "b" and not (tmp_path / "in/b").exists():
                feed(spark, tmp_path, "in/b", ("z", "2024-01-03 00:00:00"))
            stream = stream_files(spark, f"{tmp_path}/in/*", schema, max_files_per_trigger=1)
            write_available(windowed(stream, "t", every, "10 minutes", [F.count("*").alias("n")], slide), f"{tmp_path}/cp-{slide}", target)
        got = spark.read.parquet(target).filter("window_start < '2024-01-02'")
        assert sorted((str(r.window_start)[11:16], r.n) for r in got.collect()) == want


def test_sessions_and_dedupe(spark, tmp_path):
    day = "2024-01-01 "
    schema = feed(spark, tmp_path, "in/a", ("a", day + "10:00:00"), ("a", day + "10:04:00"), ("a", day + "10:30:00"), ("b", day + "10:01:00"), ("b", day + "10:02:00"))
    feed(spark, tmp_path, "in/b", ("z", "2024-01-03 00:00:00"))
    read = lambda: stream_files(spark, f"{tmp_path}/in/*", schema)
    write_available(sessions(read(), "t", "10 minutes", "1 minute", [F.count("*").alias("n")], ("k",)), f"{tmp_path}/cp", f"{tmp_path}/out")
    assert sorted((r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.k != "z") == [("a", 1), ("a", 2), ("b", 2)]
    write_available(deduplicated(read(), ["k"], "t", "1 hour"), f"{tmp_path}/cp2", f"{tmp_path}/out2")
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == ["a", "b", "z"]


def test_handlers_get_the_state_of_their_batch(spark, tmp_path):
    schema = feed(spark, tmp_path, "in", ("a", "2024-01-01 10:00:00"))
    feed(spark, tmp_path, "in", ("b", "2024-01-01 10:00:00"))
    seen = []

    def handler(df, epoch, state):
        state.save_json("n", state.load_json("n", 0) + df.count())
        seen.append((epoch, state.load_json("n", current=True)))

    run_available(stream_files(spark, f"{tmp_path}/in", schema, max_files_per_trigger=1), tmp_path / "cp", handler)
    assert seen == [(0, 1), (1, 2)]
