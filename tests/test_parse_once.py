"""A line of a file of records is parsed once, whatever is asked of it."""

from pyspark.sql import functions as F

from emberwatch.sources import feeds

HEAD = '{"class_uid":1007,"class_name":"x","time":1,"severity_id":1,"metadata":{"product":"p","version":"1","tenant_id":"t"},"device":{"hostname":"h","os":"l","os_version":"1"}'


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([(HEAD + ',"data":{"n":1}}',), (HEAD + "}",), (" ",), ("",), (None,), ("null",), ("x",)], "value string").repartition(2)
    good, bad = feeds.parse_envelopes(lines)
    seen, _ = feeds.observed_envelopes(lines)
    for df in (good, bad, seen, feeds.of_class(good, 1007).select("time"), good.select(F.get_json_object("data", "$.n"), "device.hostname")):
        assert plan(df).count("from_json") == 1
    assert [tuple(r) for r in good.select("class_uid", "data").collect()] == [(1007, '{"n":1}')] == [tuple(r) for r in seen.select("class_uid", "data").collect()]
    assert sorted(r["line"] for r in bad.collect()) == sorted([HEAD + "}", "null", "x"])
