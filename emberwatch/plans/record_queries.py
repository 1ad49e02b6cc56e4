"""Queries over OCSF records: event files, envelopes of every class, whole runs, and what they become on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.fixtures import SBOM, SENSOR_EVENTS, sbom_components, sensor_events, table
from emberwatch.functions import rules as R
from emberwatch.operators import asof as J
from emberwatch.operators import findings as O
from emberwatch.operators import posture as P
from emberwatch.operators import records as C
from emberwatch.operators import scorecard as B
from emberwatch.operators import vulnerabilities as V
from emberwatch.plans import detection as D
from emberwatch.plans import inventory_queries as IQ
from emberwatch.plans import posture_reports as PR
from emberwatch.plans import sqltext as Q
from emberwatch.plans import vulnerability as VQ
from emberwatch.sources import feeds, sinks
from emberwatch.sources.shared import cut, scratch

_E = f"WITH RECURSIVE {SENSOR_EVENTS}"
_KINDS = {"signup": 1007, "click": 4001, "purchase": 1001, "error": 9001}


def event_text(spark: SparkSession, sf: str) -> DataFrame:
    """The events as lines of an event file: some are blank, cut off, or lack a field."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    uid = F.lit(9002)
    for kind, class_uid in _KINDS.items():
        uid = F.when(F.col("event_type") == kind, class_uid).otherwise(uid)
    found = F.concat(F.lit('[{"rule":"r'), (F.col("k") % 4).cast("string"), F.lit('","reason":"say \\"rule\\": \\"no\\""},{"bad":1},7]'))
    found = F.when(F.col("k") % 5 == 0, "[]").when(F.col("k") % 7 == 0, '"none"').otherwise(found)
    deep = F.concat(F.lit('{"a":[{"b":{"rule":"d'), (F.col("k") % 3).cast("string"), F.lit('"}}],"rule":3}'))
    where = F.when(F.col("k") % 2 == 0, F.concat(F.lit('"file":{"path":"/p'), (F.col("k") % 6).cast("string"), F.lit('"},'))).otherwise("")
    data = F.concat(F.lit("{"), where, F.lit('"n":'), F.col("event_id").cast("string"), F.lit(',"detections":'), found, F.lit(',"process":{"detections":[{"rule":"p\\u00e9"}]},"deep":'), deep, F.lit("}"))
    device = F.when(F.col("event_id") % 17 == 0, "").otherwise('"device":{"hostname":"h","os":"linux","os_version":"1"},')
    line = F.concat(F.lit('{"class_uid":'), uid.cast("string"), F.lit(',"class_name":"x","time":'), F.col("event_id").cast("string"), F.lit(',"severity_id":1,"metadata":{"product":"p","version":"1","tenant_id":"t"},'), device, F.lit('"data":'), data, F.lit("}"))
    return e.select(F.when(F.col("event_id") % 13 == 0, "  ").when(F.col("event_id") % 11 == 0, '{"class_uid": 1007').otherwise(line).alias("value"))


_UID = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _KINDS.items()) + " ELSE 9002 END"
_LINES = f"""WITH lines AS (SELECT event_id, {_UID} AS class_uid, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  event_id % 13 = 0 AS blank, event_id % 13 <> 0 AND (event_id % 11 = 0 OR event_id % 17 = 0) AS bad FROM events)"""


def event_lines(spark, sf):
    """Flagged records by class and first rule, and under class 0 the lines that were rejected."""
    folder = scratch(spark, "events")
    event_text(spark, sf).write.text(folder)
    good, bad = feeds.read_events(spark, folder)
    d = good.select("class_uid", feeds.detections(F.col("data")).alias("d")).where(F.size("d") > 0)
    g = d.groupBy("class_uid", F.get("d", 0)["rule"].alias("rule")).agg(F.count("*").alias("records"))
    return g.unionByName(bad.agg(F.count("*").alias("records")).select(F.lit(0).alias("class_uid"), F.lit("rejected").alias("rule"), "records"))


def record_rules(spark, sf):
    """All rules of each record, at any depth."""
    good = event_text(spark, sf).where(F.trim("value") != "")
    r = good.select(F.get_json_object("value", "$.data.n").cast("long").alias("event_id"), F.array_join(feeds.rules_at_any_depth(F.col("value")), ",").alias("rules"), F.array_join(F.array_sort(feeds.rules_of(F.col("value"))), ",").alias("at_known_places"))
    return r.where("event_id IS NOT NULL")


def class_of(spark, sf):
    """Records of one class."""
    good, _ = feeds.parse_envelopes(event_text(spark, sf))
    return feeds.of_class(good, 1007).select(F.col("time").alias("event_id"))


def envelopes(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all classes, as a host's agent would write them."""
    e = sensor_events(spark, sf)
    level = R.severity(F.col("hits"))
    out = [C.activity_envelopes(d.records(e), d.class_uid, level) for d in D.DETECTORS.values()]
    out.append(C.activity_envelopes(D.correlation_records(e), 9002, F.lit(4)))
    snap, now = PR.snapshots(spark, sf), F.lit(5)
    out.append(C.posture_envelopes(P.evaluate_controls(snap), 2003, now))
    out.append(C.posture_envelopes(P.drift(snap, PR.baseline(spark)), 5002, now))
    out.append(C.posture_envelopes(P.integrity(*PR.watched_files(spark, sf)), 2004, now))
    out.append(C.sbom_envelopes(sbom_components(spark, sf), now))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """What is telemetry only: the first load of each library of a host (9003), and connections of AI tools (9004)."""
    e = sensor_events(spark, sf)
    loads = P.first_sightings(e.where((F.col("kind") == "FileOpen") & R.is_shared_library(F.col("path"))))
    uses = IQ.ai_egress_records(IQ.ai_images(e))
    return C.load_envelopes(loads, F.col("ts")).unionByName(C.tool_envelopes(uses, F.col("ts")))


def read_back(spark: SparkSession, sf: str) -> DataFrame:
    """The same after a file of NDJSON."""
    folder = scratch(spark, "records")
    sinks.record_lines(envelopes(spark, sf).unionByName(observations(spark, sf))).write.text(folder)
    return feeds.parse_envelopes(spark.read.text(folder))[0]


def class_records(spark, sf):
    """Conformance, severities and numbers of detections of what is written."""
    e = read_back(spark, sf)
    checked = B.violations(e).withColumn("found", F.size(feeds.detections(F.col("data"))))
    g = checked.groupBy("class_uid").agg(F.count("*").alias("records"), F.count_if(F.size("violations") == 0).alias("passed"), F.max("severity_id").cast("int").alias("severity_id"), F.sum("found").alias("detections"))
    return g


def vulnerable(spark: SparkSession, e: DataFrame) -> DataFrame:
    """Findings of the inventories among records."""
    sbom = cut(C.components_of(e))
    hits = V.composite_hits(*VQ._hits(spark, V.distinct_components(sbom), "osv", "nvd", "feed"))
    return V.vulnerability_findings(V.detections(sbom, hits), VQ.enriched(spark))


def findings_of(spark: SparkSession, e: DataFrame) -> DataFrame:
    """Findings of records of any class."""
    return C.all_class_findings(e, vulnerable(spark, e))


def _run(spark, sf):
    e = cut(read_back(spark, sf))
    return C.run_all(e, O.empty_state(spark), vulnerable(spark, e))


def all_class_findings(spark, sf):
    return _run(spark, sf)[0].select("finding_id", "risk", "decision", "status", "remediation_key")


def all_class_fixes(spark, sf):
    g = _run(spark, sf)[1]
    return g.select("remediation_key", "risk", F.col("closes_count").alias("closes"), F.col("assets_count").alias("assets"))


def ingest_counts(spark, sf):
    """A whole ingest of an event file: lines read, blank and rejected ones, as the one scan of the lines counted them, and
    the findings by class that it wrote."""
    folder = scratch(spark, "ingest")
    event_text(spark, sf).write.text(f"{folder}/lines")
    good, skipped = feeds.observed_envelopes(spark.read.text(f"{folder}/lines"))
    C.all_class_findings(good).write.parquet(f"{folder}/findings")
    n = skipped.get
    found = spark.read.parquet(f"{folder}/findings").groupBy("location").agg(F.count("*").alias("findings"), F.max("risk").alias("risk"))
    return found.select("location", "findings", "risk", *[F.lit(n[c]).cast("long").alias(c) for c in ("n_lines", "n_blank", "n_skipped")])


_POSTURE = f"s AS (SELECT 'sup-' || s_suppkey AS asset_id, s_suppkey, s_nationkey, s_acctbal FROM supplier), {PR._CONTROLS[:-1]}"
_FIM = "SELECT asset_id, 'fim-passwd' AS vuln_id, '/etc/passwd' AS component, 'filesystem' AS location, CAST(0.9 AS REAL) AS w, 'investigate:/etc/passwd' AS remediation_key FROM s WHERE s_suppkey % 6 = 0 OR s_suppkey % 8 = 0 OR s_nationkey % 4 = 0 UNION ALL SELECT asset_id, 'fim-sshd', '/etc/ssh/sshd_config', 'filesystem', CAST(0.8 AS REAL), 'restore:/etc/ssh/sshd_config' FROM s"
_TOPS = (
    f"{D.CORRELATED}, d AS (WITH {D._chain_sql(*D._DROP)} SELECT * FROM chains), x AS (WITH {D._chain_sql(*D._EXFIL)} SELECT * FROM chains), "
    "tops AS (SELECT asset_id, ts, process, daddr, dport, [rule] AS rules FROM correlated WHERE kind = 'NetConnect' AND rule IS NOT NULL UNION ALL SELECT asset_id, ts, process, daddr, dport, [rule] FROM d UNION ALL SELECT asset_id, ts, process, daddr, dport, ['read_of_sensitive_file', 'suspicious_process_suspicious_connection', rule] FROM x)"
)
_EVERY = f"{Q.ALL_RAW} UNION ALL {D._raw} UNION ALL {PR._C} UNION ALL {PR._DR} UNION ALL {_FIM}"
_ALL = f"{_E}, {Q.RECORDS}, {_POSTURE}, {_TOPS}, weighted AS (WITH {Q.findings(_EVERY)} SELECT finding_id, asset_id, vuln_id, risk, decision, status, remediation_key FROM findings), vulnerable AS ({VQ._FIND} SELECT finding_id, asset_id, vuln_id, risk, decision, status, remediation_key FROM findings), found AS (SELECT * FROM weighted UNION ALL SELECT * FROM vulnerable)"


def network_inventory(spark, sf):
    """Hosts found in the blocks that a scanner swept (class 9005 data); silent where there is none."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("scanner-"), (F.col("c_nationkey") % 7).cast("string")).alias("asset_id"), F.concat(F.lit("10.0."), (F.col("c_custkey") % 200).cast("string"), F.lit(".0/24")).alias("cidr"), F.when(F.col("c_nationkey") % 7 != 3, F.concat(F.lit("10.0."), (F.col("c_custkey") % 200).cast("string"), F.lit("."), (F.col("c_custkey") % 250).cast("string"))).alias("addr"))
    n = P.network_inventory(c.where("addr IS NOT NULL").select("asset_id", "addr"), c.select("asset_id", "cidr"))
    return n.select("asset_id", "role", F.size("swept_cidrs").cast("long").alias("cidrs"), "host_count", F.array_min("hosts").alias("first"))


def host_inventory(spark, sf):
    """Systems with their packages and their number (class 5001 data)."""
    s = sbom_components(spark, sf)
    os = s.select("asset_id", "os").distinct()
    i = P.host_inventory(os.select("asset_id", F.col("os").alias("name")), s.select("asset_id", "name", "version", "source"))
    return i.select("asset_id", F.get("os", 0)["name"].alias("os"), "package_count", F.array_join(F.array_distinct(F.transform("packages", lambda p: p["name"])), ",").alias("names"))


def day_files(spark, sf):
    """Records by day, written as a day's files and read by name."""
    folder = scratch(spark, "days")
    o = table(spark, sf, "orders").select("o_orderkey", (F.lit(1704067200000) + F.col("o_orderkey") % 40 * 86400000).alias("time"))
    sinks.write_by_day(o, folder, F.col("time"), rows_per_file=1000)
    d = spark.read.parquet(folder).withColumn("file", F.col("_metadata.file_path"))
    return d.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.countDistinct("day").alias("days"), F.count("*").alias("records"), (F.countDistinct("file") >= F.countDistinct("day")).alias("split"))


def snapshot_tables(spark, sf):
    """A snapshot table by its name."""
    folder = scratch(spark, "snapshots")
    s = table(spark, sf, "supplier").select(F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("asset_id"), F.lit("PermitRootLogin").alias("key"), F.when(F.col("s_nationkey") % 2 == 0, "no").otherwise("yes").alias("value"))
    s.write.parquet(f"{folder}/sshd_config")
    return feeds.read_snapshot(spark, folder, "sshd_config").groupBy("value").agg(F.count("*").alias("hosts"))


def ordered_lines(spark, sf):
    """Findings as NDJSON in the order of their identity: `ordinal` is the line's place."""
    folder = scratch(spark, "lines")
    f = D.all_findings(sensor_events(spark, sf)).select("finding_id", "risk", "closed_at")
    sinks.write_ndjson(f, folder, {"risk": "R"}, ["finding_id"])
    lines = spark.read.text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    l = lines.select("file", F.get_json_object("value", "$.finding_id").alias("finding_id"), F.get_json_object("value", "$.R").cast("int").alias("R"), F.col("value").contains('"closed_at":null').alias("null_kept"))
    # Files are ranges: a file's last line precedes the next file's first.
    per_file = l.groupBy("file").agg(F.min("finding_id").alias("low"), F.max("finding_id").alias("high"), F.count("*").alias("lines"), F.bool_and("null_kept").alias("null_kept"), F.max("R").alias("top"))
    ordered = F.coalesce(F.lag("high").over(Window.orderBy("file")) < F.col("low"), F.lit(True))  # a row a file
    return per_file.withColumn("ordered", ordered).agg(F.sum("lines").alias("lines"), F.bool_and("ordered").alias("ordered"), F.bool_and("null_kept").alias("null_kept"), F.max("top").alias("top"))


def chains_by_day(spark, sf):
    c = J.chains(J.correlated(sensor_events(spark, sf)))
    w = F.window(F.timestamp_millis("ts"), "1 day")
    return c.groupBy(w.alias("w")).agg(F.count("*").alias("chains")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "chains")


def posture_counts(spark, sf):
    """Passed and failed controls, drifted entries, changed files, and the volume of events."""
    snap = PR.snapshots(spark, sf)
    c = P.evaluate_controls(snap).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    d = P.drift(snap, PR.baseline(spark)).agg(F.count_if("drifted").alias("drifted"))
    i = P.integrity(*PR.watched_files(spark, sf)).agg(F.count_if("violated").alias("changed"))
    v = sensor_events(spark, sf).agg(F.count("*").alias("events"))
    one = None
    for name, x in (("passed", c), ("failed", c), ("drifted", d), ("changed", i), ("events", v)):
        part = x.select(F.lit(name).alias("measure"), F.col(name).alias("value"))
        one = part if one is None else one.unionByName(part)
    return one


QUERIES = {
    "event_lines": event_lines,
    "record_rules": record_rules,
    "process_class": class_of,
    "class_records": class_records,
    "all_class_findings": all_class_findings,
    "all_class_fixes": all_class_fixes,
    "ingest_counts": ingest_counts,
    "host_inventory": host_inventory,
    "network_inventory": network_inventory,
    "day_files": day_files,
    "snapshot_tables": snapshot_tables,
    "ordered_lines": ordered_lines,
    "chains_by_day": chains_by_day,
    "posture_counts": posture_counts,
}
_LIST = "k % 5 <> 0 AND k % 7 <> 0"
SQL = {
    "event_lines": f"{_LINES} SELECT class_uid, 'r' || (k % 4) AS rule, count(*) AS records FROM lines WHERE NOT blank AND NOT bad AND {_LIST} GROUP BY 1, 2 UNION ALL SELECT 0, 'rejected', count(*) FILTER (bad) FROM lines",
    "record_rules": f"{_LINES} SELECT event_id, 'd' || (k % 3) || ',pé' || CASE WHEN {_LIST} THEN ',r' || (k % 4) ELSE '' END AS rules, 'pé' || CASE WHEN {_LIST} THEN ',r' || (k % 4) ELSE '' END AS at_known_places FROM lines WHERE NOT blank AND event_id % 11 <> 0",
    "process_class": f"{_LINES} SELECT event_id FROM lines WHERE NOT blank AND NOT bad AND class_uid = 1007",
    "class_records": f"""{_E}, {Q.RECORDS}, {_POSTURE}, {SBOM}, {_TOPS}, r AS (SELECT 1007 AS class_uid, rules FROM process_records UNION ALL SELECT 4001, rules FROM network_records UNION ALL SELECT 1001, rules FROM file_records UNION ALL SELECT 9002, rules FROM tops
        UNION ALL SELECT 2003, NULL FROM ctl GROUP BY asset_id UNION ALL SELECT 5002, NULL FROM s UNION ALL SELECT 2004, NULL FROM s UNION ALL SELECT 5020, NULL FROM sbom GROUP BY asset_id, os
        UNION ALL SELECT 9003, NULL FROM sensor_events WHERE kind = 'FileOpen' AND contains(path, '.so.') GROUP BY asset_id, path
        UNION ALL SELECT 9004, NULL FROM (SELECT unnest(range(CAST(n AS BIGINT))) FROM (SELECT sum(connections) AS n FROM ({IQ.SQL["ai_egress"]}) a) b) c)
        SELECT class_uid, count(*) AS records, count(*) AS passed, max(CASE class_uid WHEN 9002 THEN 4 ELSE coalesce(list_max(list_transform(rules, lambda r: CASE r {" ".join(f"WHEN '{r}' THEN {s}" for r, s in R.SEVERITY.items())} ELSE 1 END)), 1) END) AS severity_id, CAST(sum(coalesce(len(rules), 0)) AS BIGINT) AS detections FROM r GROUP BY 1""",
    "all_class_findings": f"{_ALL} SELECT finding_id, risk, decision, status, remediation_key FROM found",
    "all_class_fixes": f"{_ALL} SELECT remediation_key, max(risk) AS risk, count(DISTINCT vuln_id) AS closes, count(DISTINCT asset_id) AS assets FROM found GROUP BY 1",
    "ingest_counts": f"""{_LINES}, n AS (SELECT count(*) AS n_lines, count(*) FILTER (blank) AS n_blank, count(*) FILTER (bad) AS n_skipped FROM lines),
        f AS (SELECT DISTINCT CASE WHEN class_uid = 1007 THEN 'process' ELSE '/p' || (k % 6) END AS location FROM lines WHERE NOT blank AND NOT bad AND {_LIST} AND (class_uid = 1007 OR (class_uid = 1001 AND k % 2 = 0)))
        SELECT location, CAST(1 AS BIGINT) AS findings, 22 AS risk, n_lines, n_blank, n_skipped FROM f, n""",
    "host_inventory": f"WITH {SBOM}, d AS (SELECT DISTINCT asset_id, name, version, source, os FROM sbom) SELECT asset_id, min(os) AS os, count(*) AS package_count, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM d GROUP BY asset_id",
    "network_inventory": "WITH c AS (SELECT 'scanner-' || (c_nationkey % 7) AS asset_id, c_nationkey % 7 AS z, '10.0.' || (c_custkey % 200) AS net, c_custkey % 250 AS h FROM customer) SELECT asset_id, 'network-scanner' AS role, count(DISTINCT net) AS cidrs, count(DISTINCT net || '.' || h) AS host_count, min(net || '.' || h) AS first FROM c WHERE z <> 3 GROUP BY 1",
    "day_files": "SELECT strftime(d, '%Y-%m') AS month, count(DISTINCT d) AS days, count(*) AS records, true AS split FROM (SELECT CAST(DATE '2024-01-01' + CAST(o_orderkey % 40 AS INTEGER) AS DATE) AS d FROM orders) o GROUP BY 1",
    "snapshot_tables": "SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'no' ELSE 'yes' END AS value, count(*) AS hosts FROM supplier GROUP BY 1",
    "ordered_lines": f"{_E}, {Q.RECORDS}, {Q.findings(Q.ALL_RAW)} SELECT count(*) AS lines, true AS ordered, true AS null_kept, max(risk) AS top FROM findings",
    "chains_by_day": f"{_E}, {_TOPS} SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, count(*) AS chains FROM (SELECT ts FROM d UNION ALL SELECT ts FROM x) u GROUP BY 1",
    "posture_counts": f"WITH {_POSTURE} SELECT 'passed' AS measure, count(*) FILTER (passed) AS value FROM ctl UNION ALL SELECT 'failed', count(*) FILTER (NOT passed) FROM ctl UNION ALL SELECT 'drifted', count(*) FROM ({PR._DR}) a UNION ALL SELECT 'changed', count(*) FROM ({_FIM}) b UNION ALL SELECT 'events', count(*) FROM events",
}
