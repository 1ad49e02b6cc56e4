"""Streams over tables of several files: no order of files or rows changes what they tell."""

import json

from pyspark.sql import functions as F

from emberwatch.plans import stream_queries as SQ
from emberwatch.sources import sinks
from emberwatch.streaming import jobs as S


def test_files_out_of_order(spark, sf, tmp_path, monkeypatch):
    e = spark.read.parquet(f"{sf}/events.parquet")
    middle = e.agg(F.percentile("event_id", 0.8)).first()[0]
    folder = str(tmp_path / "events.parquet")
    # The smaller file has the later events, and is ready before the other.
    e.where(F.col("event_id") <= middle).coalesce(1).write.parquet(folder)
    e.where(F.col("event_id") > middle).coalesce(1).write.mode("append").parquet(folder)
    monkeypatch.setattr(SQ, "SLICE", 700, raising=False)
    daily = SQ.stream_daily_activity(spark, str(tmp_path))
    assert daily.agg(F.sum("detections")).first()[0] == e.count()
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    split, whole = SQ.stream_attribution(spark, str(tmp_path)), SQ.stream_attribution(spark, sf)
    assert told(split) == told(whole)


def test_a_batch_tells_the_earliest_sighting(spark, tmp_path):
    known = sinks.StateTable(spark, str(tmp_path / "k"), spark.createDataFrame([], S.SIGHTINGS), ("asset_id", "path"))
    for ts in (5000, 9000, 1000, 7000):  # a file each, in one batch
        spark.createDataFrame([("h", "/a", ts)], S.SIGHTINGS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    loads = S.with_event_time(spark.readStream.schema(S.SIGHTINGS).parquet(str(tmp_path / "in")), "ts", "1 second")
    S.first_sightings_loop(loads, known, str(tmp_path / "c")).awaitTermination()
    assert [tuple(r) for r in known.load().collect()] == [("h", "/a", 1000)]


def test_state_follows_groups_not_owners(spark, tmp_path):
    """Waiting rows of many keys are entries of a group; those of one key come in their order over batches."""
    rows = [(f"k{k}", 5001, 10**6 + t * 1000, t, json.dumps({"v": t // 2})) for k in range(300) for t in range(6)]
    schema = "asset_id string, class_uid int, ts long, seq long, payload string"
    frame = spark.createDataFrame(rows, schema)
    for part in ("seq % 2 = 1", "seq % 2 = 0"):
        frame.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([("~", 5001, 10**9, 0, "end")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "ts", "1 minute")
    out = SQ._run(spark, S.change_gate_stream(stream), "changes", str(tmp_path / "run"))
    got = out.where("asset_id <> '~'").groupBy("asset_id").agg(F.array_sort(F.collect_list("seq")).alias("s"))
    assert [tuple(r["s"]) for r in got.select("s").distinct().collect()] == [(0, 2, 4)] and got.count() == 300
