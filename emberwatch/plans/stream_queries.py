"""Streaming queries: the events table as a stream, run to its end, and what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.fixtures import SBOM, SENSOR_EVENTS, sensor_events, table
from emberwatch.functions import ai as A
from emberwatch.operators import findings as O
from emberwatch.operators import records as C
from emberwatch.plans import detection as D
from emberwatch.plans import feed_queries as FQ
from emberwatch.plans import inventory_queries as IQ
from emberwatch.plans import sqltext as Q
from emberwatch.plans import record_queries as RQ
from emberwatch.plans.record_queries import _LINES, event_text
from emberwatch.sources import sinks as S_
from emberwatch.sources.feeds import parse_envelopes
from emberwatch.sources.shared import cut, scratch, spread
from emberwatch.sources.sinks import StateTable
from emberwatch.streaming import jobs as S


def _events(spark: SparkSession, sf: str, with_k: bool) -> DataFrame:
    e = sensor_events(spark, sf)
    e = e if with_k else e.drop("k")
    return e.withColumns({"cmdline": F.lit(None).cast("string"), "image_trusted": F.lit(None).cast("boolean"), "proto": F.lit("tcp"), "dport": F.col("dport").cast("int")})


def _stream(spark: SparkSession, sf: str, with_k: bool = False) -> DataFrame:
    """The derived events as a stream of files. An exit far in the future, of no host, moves the watermark past all others."""
    folder = scratch(spark, "events")
    e = _events(spark, sf, with_k)
    schema = S.EVENT + (", k int" if with_k else "")
    names = [x.split()[0] for x in schema.split(", ")]
    e.select(*names).write.parquet(f"{folder}/a")
    last = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit("~").alias("asset_id"), F.lit("ProcessExit").alias("kind"), (F.col("ts") + 86400000).alias("ts"), F.lit(-1).cast("long").alias("pid"))
    last.write.parquet(f"{folder}/b")
    return S.with_event_time(spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder), "ts", "1 seconds")


def _run(spark: SparkSession, out: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Runs a stream to the end of its input, or on from where it stopped in `folder`. State lives in RocksDB; the session's
    own setting is put back."""
    folder, key = folder or scratch(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.ROCKSDB)
    try:
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


#: Rows of a slice of a replayed stream.
SLICE = 2_000_000


def _replay(spark: SparkSession, sf: str, job, name: str, with_k: bool = False) -> DataFrame:
    """What `job` makes of the derived events, which come in slices of event time, one after the other: files of one table have
    no order, and a row that comes when the watermark has passed it is dropped. Rows are spread first, so a slice is read by all
    tasks and not by the few whose rows it holds. The last slice moves the watermark on."""
    folder = scratch(spark, name)
    schema = S.EVENT + (", k int" if with_k else "")
    e = _events(spark, sf, with_k).select(*[x.split()[0] for x in schema.split(", ")])
    n = max(1, -(-e.count() // SLICE))
    ends = e.agg(F.percentile_approx("ts", [k / n for k in range(1, n)] or [0.5]).alias("ends"), F.max("ts").alias("last")).first()
    bounds = sorted(set(ends["ends"] or [])) if n > 1 else []
    nth = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), lambda b: b < F.col("ts")))
    spread(e.withColumn("slice", nth)).write.partitionBy("slice").parquet(f"{folder}/slices")
    last = spark.createDataFrame([(-1, "~", "ProcessExit", (ends["last"] or 0) + 86400000, -1)], "event_id long, asset_id string, kind string, ts long, pid long")
    slices = spark.read.schema(schema + ", slice int").parquet(f"{folder}/slices")
    parts = [*(slices.where(F.col("slice") == k).drop("slice") for k in range(len(bounds) + 1)), last]
    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        out = _run(spark, job(S.with_event_time(spark.readStream.schema(schema).parquet(f"{folder}/in"), "ts", "1 seconds")), name, folder)
    return out


def stream_network_rules(spark, sf):
    r = D.network_records(_stream(spark, sf)).where(F.size("hits") > 0)
    return _run(spark, r.select("event_id", "asset_id", D.rules_of().alias("rules")), "rules")


def stream_attribution(spark, sf):
    return _replay(spark, sf, S.attribute_stream, "attribution").select("event_id", "asset_id", "pid", "kind", "exec_id")


def stream_lifetimes(spark, sf):
    return _replay(spark, sf, S.lifetime_stream, "lifetimes").where("asset_id <> '~'").select("event_id", "image", "lifetime_ms", "matched")


def stream_first_sightings(spark, sf):
    """Opened paths by host, as a stream that is stopped, goes on, and is then read again from the start by another one. Only
    sightings that none of them had told before are there."""
    folder = scratch(spark, "loads")
    known = StateTable(spark, scratch(spark, "known"), spark.createDataFrame([], S.SIGHTINGS), ("asset_id", "path"))
    e = cut(sensor_events(spark, sf).where("kind = 'FileOpen'").select("asset_id", "path", "ts"))
    middle = e.agg(F.avg("ts").cast("long").alias("m")).first()["m"] or 0
    loads = lambda: S.with_event_time(spark.readStream.schema(e.schema).parquet(folder), "ts", "1 minute")
    for part in (F.col("ts") <= middle, F.col("ts") > middle):
        e.where(part).write.mode("append").parquet(folder)
        S.first_sightings_loop(loads(), known, f"{folder}-1").awaitTermination()
    told = known.load().count()
    S.first_sightings_loop(loads(), known, f"{folder}-2").awaitTermination()
    return known.load().withColumn("told", F.lit(told).cast("long"))


def stream_reachability(spark, sf):
    """Which packages were seen in use, out of a stream of inventories and loads that come in turns: what holds in the end."""
    folder = scratch(spark, "mixed")
    libraries, loads = FQ.libraries_and_loads(spark, sf)
    c = libraries.groupBy("asset_id", F.col("component").alias("name")).agg(F.array_sort(F.collect_list("path")).alias("libraries"))
    inventories = C.sbom_envelopes(c.withColumns({"version": F.lit("1"), "source": F.lit("dpkg"), "os": F.lit("Debian")}), F.lit(5))
    every = cut(inventories.unionByName(C.load_envelopes(loads, F.lit(7))))
    turn = F.pmod(F.xxhash64("device.hostname", "class_uid"), F.lit(3))
    out = None
    for k in range(3):  # of some hosts the loads come first
        S_.record_lines(every.where(turn == k)).write.mode("append").text(f"{folder}/lines")
        good = parse_envelopes(spark.readStream.text(f"{folder}/lines"))[0]
        out = _run(spark, S.reachability_stream(good), "reached", folder)
    return out.groupBy("asset_id", "component").agg(F.max("runtime_reachable").alias("runtime_reachable"))


def stream_daily_activity(spark, sf):
    daily = lambda e: S.daily_activity_stream(e.select("event_time", F.col("kind").alias("category")))
    return _replay(spark, sf, daily, "activity")  # the last row's own day stays open


AGAIN = ["host-1", "host-3"]


def stream_findings_state(spark, sf):
    """Records of all classes through the findings loop, in two batches and over a restart: activity first, then posture,
    inventories, and connections of some hosts again. Leaves the findings of all records, with when they were seen."""
    folder, state = scratch(spark, "records"), StateTable(spark, scratch(spark, "state"), O.empty_state(spark))
    every, loop = cut(RQ.envelopes(spark, sf)), scratch(spark, "loop")
    activity, again = F.col("class_uid").isin(1007, 4001, 1001, 9002), (F.col("class_uid") == 4001) & F.col("device.hostname").isin(AGAIN)
    lines = S_.record_lines(every)
    for part in (every.where(activity), every.where(~activity | again)):
        S_.record_lines(part).write.mode("append").text(folder)
        stream = parse_envelopes(spark.readStream.schema(lines.schema).text(folder))[0]
        S.findings_loop(stream, lambda b: RQ.findings_of(spark, b), state, loop, "time").awaitTermination()
    return state.load().select("finding_id", "risk", "decision", "remediation_key", "first_seen", "last_seen")


def stream_process_rules(spark, sf):
    r = D.process_records(_stream(spark, sf)).where(F.size("hits") > 0)
    return _run(spark, r.select("event_id", "asset_id", D.rules_of().alias("rules")), "rules")


def stream_file_rules(spark, sf):
    return _run(spark, D.file_records(_stream(spark, sf)).select("event_id", "asset_id", D.rules_of().alias("rules")), "rules")


def stream_ai_tools(spark, sf):
    """Execs by what AI tool their image is, without state."""
    e = IQ.ai_images(_stream(spark, sf, with_k=True)).where("kind = 'ProcessExec'")
    return _run(spark, e.select("event_id", A.tool_of(F.col("image")).alias("tool")).where("tool IS NOT NULL"), "tools")


def stream_correlation(spark, sf):
    """Single records of the stateful correlation."""
    c = _replay(spark, sf, S.correlation_stream, "correlation").where("record = 'event'")
    return c.select("event_id", "asset_id", "kind", F.col("exec_id").isNotNull().alias("attributed"), "process", "exec_id", "process_severity", "inherited", "event_severity", "rule", "severity_id")


def stream_chains(spark, sf):
    """Chains of the stateful correlation."""
    c = _replay(spark, sf, lambda e: S.correlation_stream(e, single=False), "chains").where("record = 'chain'")
    return c.select("asset_id", "pid", "exec_id", "ts", "process", "first_id", "connect_id", "rule")


def stream_tool_use(spark, sf):
    """AI egress with the interpreter's command line kept as state."""
    t = _replay(spark, sf, lambda e: S.tool_stream(IQ.ai_images(e)), "tool_use", with_k=True)
    return t.groupBy("tool", "via", "scope", "record").agg(F.count("*").alias("connections"), F.countDistinct("asset_id").alias("hosts"))


def stream_changes(spark, sf):
    """Orders as snapshots of their customer, in three batches that overlap by weeks: those that change the status, as if they
    had come in order."""
    folder = scratch(spark, "snapshots")
    o = table(spark, sf, "orders").select(F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("asset_id"), F.lit(5001).alias("class_uid"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("payload"))
    o, day = cut(o), 86_400_000
    span = o.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    low, high = span["a"] or 0, span["b"] or 0
    late = F.col("ts") + F.pmod(F.xxhash64("seq"), F.lit(40)) * day  # when it arrives
    batch = F.floor((late - low) * 3 / (high - low + 40 * day + 1))
    last = spark.createDataFrame([("~", 5001, high + 400 * day, -1, "end")], o.schema)
    out = None
    for part in (*(o.where(batch == k) for k in range(3)), last):
        part.write.mode("append").parquet(f"{folder}/in")
        s = S.with_event_time(spark.readStream.schema(o.schema).parquet(f"{folder}/in"), "ts", "60 days")
        out = _run(spark, S.change_gate_stream(s), "changes", folder)
    return out.where("asset_id <> '~'").select("asset_id", "seq", "payload")


def stream_envelopes(spark, sf):
    """Event files as a stream, by class; and sensor events of some kinds only."""
    folder = scratch(spark, "lines")
    event_text(spark, sf).write.text(f"{folder}/lines")
    e = _run(spark, S.envelope_stream(spark, f"{folder}/lines").select(F.col("class_uid").cast("string").alias("what"), F.col("time").alias("event_id")), "envelopes")
    _events(spark, sf, with_k=False).select(*[x.split()[0] for x in S.EVENT.split(", ")]).write.parquet(f"{folder}/events")
    k = _run(spark, S.event_stream(spark, f"{folder}/events", ["NetConnect", "FileOpen"]).select(F.col("kind").alias("what"), "event_id"), "kinds")
    return e.unionByName(k).groupBy("what").agg(F.count("*").alias("records"), F.max("event_id").alias("last"))


def stream_files(spark, sf):
    """Records of a stream as event files (envelopes of class 4001, one a line) and as a day's files."""
    folder = scratch(spark, "sinks")
    r = D.network_records(_stream(spark, sf)).select("event_id", "asset_id", "ts", "daddr", "dport", "hits")
    S_.stream_records(C.parsed_data(C.activity_envelopes(r, 4001, F.lit(1))), f"{folder}/lines", f"{folder}/c1").trigger(availableNow=True).start().awaitTermination()
    S_.stream_by_day(r.drop("hits"), f"{folder}/days", f"{folder}/c2", F.col("ts")).trigger(availableNow=True).start().awaitTermination()
    good, bad = parse_envelopes(spark.read.text(f"{folder}/lines"))
    lines = good.where(F.get_json_object("data", "$.connection.daddr").isNotNull()).select(F.col("time").alias("ts")).join(bad.agg(F.count("*").alias("bad")).where("bad = 0"))
    days = spark.read.parquet(f"{folder}/days")
    return days.join(lines, "ts").groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("records"))


QUERIES = {
    "stream_process_rules": stream_process_rules,
    "stream_file_rules": stream_file_rules,
    "stream_ai_tools": stream_ai_tools,
    "stream_correlation": stream_correlation,
    "stream_chains": stream_chains,
    "stream_tool_use": stream_tool_use,
    "stream_changes": stream_changes,
    "stream_envelopes": stream_envelopes,
    "stream_files": stream_files,
    "stream_network_rules": stream_network_rules,
    "stream_attribution": stream_attribution,
    "stream_lifetimes": stream_lifetimes,
    "stream_first_sightings": stream_first_sightings,
    "stream_reachability": stream_reachability,
    "stream_daily_activity": stream_daily_activity,
    "stream_findings_state": stream_findings_state,
}
_E = f"WITH RECURSIVE {SENSOR_EVENTS}"
SQL = {
    "stream_process_rules": f"{_E}, {Q.RECORDS} SELECT event_id, asset_id, array_to_string(rules, ',') AS rules FROM process_records WHERE len(rules) > 0",
    "stream_file_rules": f"{_E}, {Q.RECORDS} SELECT event_id, asset_id, array_to_string(rules, ',') AS rules FROM file_records",
    "stream_ai_tools": f"{_E} SELECT event_id, CASE k % 6 WHEN 2 THEN 'cursor' WHEN 3 THEN 'github-copilot' ELSE 'claude-code' END AS tool FROM sensor_events WHERE kind = 'ProcessExec' AND k % 6 IN (2, 3, 4)",
    "stream_correlation": D.SQL["correlated_activity"],
    "stream_chains": f"{_E}, {D.CORRELATED}, d AS (WITH {D._chain_sql(*D._DROP)} SELECT * FROM chains), x AS (WITH {D._chain_sql(*D._EXFIL)} SELECT * FROM chains) SELECT asset_id, pid, exec_id, ts, process, first_id, connect_id, rule FROM (SELECT * FROM d UNION ALL SELECT * FROM x) u",
    "stream_tool_use": IQ.SQL["ai_egress"],
    "stream_changes": "SELECT 'c-' || o_custkey AS asset_id, o_orderkey AS seq, o_orderstatus AS payload FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS DISTINCT FROM o_orderstatus",
    "stream_envelopes": f"SELECT * FROM ({_LINES} SELECT CAST(class_uid AS VARCHAR) AS what, count(*) AS records, max(event_id) AS last FROM lines WHERE NOT blank AND NOT bad GROUP BY 1) a UNION ALL SELECT * FROM ({_E} SELECT kind, count(*), max(event_id) FROM sensor_events WHERE kind IN ('NetConnect', 'FileOpen') GROUP BY 1) b",
    "stream_files": f"{_E} SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, count(*) AS records FROM sensor_events WHERE kind = 'NetConnect' GROUP BY 1",
    "stream_network_rules": f"{_E}, {Q.RECORDS} SELECT event_id, asset_id, array_to_string(rules, ',') AS rules FROM network_records WHERE len(rules) > 0",
    "stream_attribution": f"{_E}, {D.CONTEXT} SELECT event_id, asset_id, pid, kind, exec_id FROM picked",
    "stream_lifetimes": f"{_E}, {D.EXITS} SELECT event_id, image, lifetime_ms, matched FROM exits",
    "stream_first_sightings": f"{_E}, f AS (SELECT asset_id, path, min(ts) AS ts FROM sensor_events WHERE kind = 'FileOpen' GROUP BY 1, 2) SELECT *, (SELECT count(*) FROM f) AS told FROM f",
    "stream_reachability": f"WITH {SBOM} SELECT DISTINCT asset_id, name AS component, CASE WHEN CAST(split_part(asset_id, '-', 2) AS BIGINT) % 4 = 1 THEN NULL ELSE CAST(split_part(asset_id, '-', 2) AS BIGINT) % 2 = 0 AND name IN ('putty', 'openssl') END AS runtime_reachable FROM sbom",
    "stream_daily_activity": f"{_E} SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, kind AS category, count(*) AS detections FROM sensor_events GROUP BY 1, 2",
    "stream_findings_state": f"""{RQ._ALL}, t AS (SELECT (SELECT max(ts) FROM (SELECT ts FROM process_records UNION ALL SELECT ts FROM network_records UNION ALL SELECT ts FROM file_records UNION ALL SELECT ts FROM tops) x) AS t1,
        (SELECT coalesce(max(ts), 5) FROM network_records WHERE asset_id IN {Q.in_list(AGAIN)}) AS t2)
        SELECT finding_id, risk, decision, remediation_key, CAST(CASE WHEN regexp_matches(vuln_id, '^(process|network|file|correlation):') THEN t1 ELSE t2 END AS BIGINT) AS first_seen,
        CAST(CASE WHEN regexp_matches(vuln_id, '^(process|file|correlation):') OR (starts_with(vuln_id, 'network:') AND asset_id NOT IN {Q.in_list(AGAIN)}) THEN t1 ELSE t2 END AS BIGINT) AS last_seen FROM found, t""",
}
