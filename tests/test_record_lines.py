"""Lines of records hold the JSON of `data` as it was written, without another parse."""

import json

from pyspark.sql import functions as F

from emberwatch.operators import records as C
from emberwatch.plans import record_queries as RQ
from emberwatch.sources import feeds, sinks


def test_data_goes_in_as_it_is(spark):
    rows = spark.createDataFrame([("h", 5, 'a"\n\\é', 0.9), ("", None, None, None)], "asset_id string, pid long, image string, w float")
    e = C.envelopes(rows, 1007, F.lit(3), F.lit(1), F.struct("w", "pid", "image", F.array(F.struct("image")).alias("detections")))
    lines = sinks.record_lines(e)
    assert "parse_json" not in lines._jdf.queryExecution().analyzed().toString().lower()
    texts = [r["value"] for r in lines.collect()]
    assert '"data":{"w":0.9,"pid":5,' in texts[0] and "\n" not in texts[0]  # the order of the fields is kept
    plain = [r["value"] for r in sinks.to_ndjson(C.parsed_data(e)).collect()]
    assert [json.loads(t) for t in texts] == [json.loads(t) for t in plain]
    good, bad = feeds.parse_envelopes(lines)
    assert bad.isEmpty() and [json.loads(r["data"]) for r in good.collect()] == [json.loads(r["data"]) for r in e.collect()]
    none = sinks.record_lines(e.withColumn("data", F.lit(None).cast("string"))).first()["value"]
    assert json.loads(none)["data"] is None


def test_records_of_all_classes_come_back_whole(spark, sf):
    e = RQ.envelopes(spark, sf)
    lines = feeds.parse_envelopes(sinks.record_lines(e))[0]
    n = lambda d: {(r["class_uid"], r["host"]): r["count"] for r in d.groupBy("class_uid", F.col("device.hostname").alias("host")).count().collect()}
    assert n(lines) == n(e)


def test_inventories_are_not_parsed_for_contributions(spark):
    rows = spark.createDataFrame([("h", "/tmp/x", [("lolbin", "r")])], "asset_id string, image string, hits array<struct<rule:string,reason:string>>").withColumn("ts", F.lit(1))
    e = C.activity_envelopes(rows, 1007, F.lit(1)).withColumn("class_uid", F.explode(F.array(F.lit(1007), F.lit(5020))))
    # A record whose `data` can't even be read stands for one that isn't parsed.
    e = e.withColumn("data", F.when(F.col("class_uid") == 5020, F.raise_error(F.lit("parsed")).cast("string")).otherwise(F.col("data"))).where("time = 1")
    assert [r["vuln_id"] for r in C.contributions(e).select("vuln_id").collect()] == ["process:/tmp/x"]
