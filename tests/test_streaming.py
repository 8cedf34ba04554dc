from __future__ import annotations

from verdigris.streaming.state import Upsert, episodes, event_counts


def test_upsert_keeps_the_last(spark, tmp_path):
    src = tmp_path / "in"
    for n, rows in enumerate(([("a", 1, "x"), ("b", 2, "y")], [("a", 3, "z")])):
        spark.createDataFrame(rows, "k string, seq int, v string").coalesce(1).write.mode("append").parquet(str(src))
    sink = Upsert(str(tmp_path / "t"), ["k"], "seq")
    stream = spark.readStream.schema("k string, seq int, v string").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["k"], r["v"]) for r in sink.read(spark).collect()) == [("a", "z"), ("b", "y")]
    # another driver goes on from what is there, and a batch that is run twice changes nothing
    again = Upsert(str(tmp_path / "t"), ["k"], "seq")
    for _ in range(2):
        again(spark.createDataFrame([("c", 4, "new")], "k string, seq int, v string"), 2)
    assert sorted((r["k"], r["v"]) for r in again.read(spark).collect()) == [("a", "z"), ("b", "y"), ("c", "new")]
    # a batch writes the buckets that it has rows for, and no others
    assert len(list((tmp_path / "t" / "v2").glob("__bucket=*"))) == 1
    again(spark.createDataFrame([], "k string, seq int, v string"), 3)
    for epoch in (4, 5):
        again(spark.createDataFrame([("c", epoch, "newer"), ("c", 1, "late")], "k string, seq int, v string"), epoch)
    assert again.vacuum(spark) == 1 and sorted((r["k"], r["v"], r["seq"]) for r in again.read(spark).collect()) == [("a", "z", 3), ("b", "y", 2), ("c", "newer", 5)]
    assert Upsert(str(tmp_path / "none"), ["k"], "seq").read(spark) is None


def test_episodes_end_at_the_limit(spark, small, tmp_path):
    kind = spark.read.parquet(f"{small}/conversations.parquet").schema
    turns = spark.readStream.schema(kind).parquet(f"{small}/conversations.parque*")
    q = episodes(turns, 6).writeStream.outputMode("update").format("memory").queryName("episodes").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("episodes").collect()
    assert sum(r["n_turns"] for r in got) == spark.read.parquet(f"{small}/conversations.parquet").count()
    assert all(r["ended"] == (r["n_turns"] >= 6) for r in got)


def test_event_windows(spark, small):
    got = event_counts(spark.read.parquet(f"{small}/events.parquet")).collect()
    assert sum(r["n"] for r in got) == 1000


def test_dialogues_in_a_folder_of_files(spark, small, tmp_path):
    """The table may be one file or a folder of files."""
    from verdigris.plans.registry import QUERIES

    spark.read.parquet(f"{small}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    one, many = (sorted(map(tuple, QUERIES["streamed_episodes"](spark, d).collect())) for d in (small, str(tmp_path)))
    assert one and one == many
