"""Queries over sensor events: rules, findings, attribution, chains and ancestry."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.fixtures import SENSOR_EVENTS, sensor_events
from emberwatch.functions import rules as R
from emberwatch.operators import asof as J
from emberwatch.operators import findings as O
from emberwatch.plans import sqltext as Q
from emberwatch.sources.shared import cut

FINDING = ["finding_id", "asset_id", "vuln_id", "component", "location", "risk", "decision", "sla_hours", "status", "remediation_key"]


def rules_of():
    return F.array_join(F.transform("hits", lambda h: h["rule"]), ",")


def process_records(events: DataFrame) -> DataFrame:
    return events.where("kind = 'ProcessExec'").select("event_id", "asset_id", "pid", "ts", "image", R.process_hits(F.col("image")).alias("hits"))


def network_records(events: DataFrame) -> DataFrame:
    return events.where("kind = 'NetConnect'").select("event_id", "asset_id", "pid", "ts", "daddr", "dport", R.network_hits(F.col("daddr"), F.col("dport")).alias("hits"))


def file_records(events: DataFrame) -> DataFrame:
    """Only flagged events give a record."""
    e = events.where(F.col("kind").isin("FileWrite", "FileOpen") & R.watched(F.col("path")))
    e = e.select("event_id", "asset_id", "pid", "ts", "path", "kind", R.file_hits(F.col("path"), F.col("kind") == "FileWrite").alias("hits"))
    return e.where(F.size("hits") > 0)


def _rules(of, *more):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        r = of(sensor_events(spark, sf))
        return r.select("event_id", "asset_id", *more, rules_of().alias("rules"), R.severity(F.col("hits")).cast("int").alias("severity_id"))

    return run


def _rules_sql(name: str, *more: str) -> str:
    levels = " ".join(f"WHEN '{r}' THEN {s}" for r, s in R.SEVERITY.items())
    return f"""WITH {SENSOR_EVENTS}, {Q.RECORDS} SELECT event_id, asset_id, {"".join(m + ", " for m in more)}array_to_string(rules, ',') AS rules,
CAST(coalesce(list_max(list_transform(rules, lambda r: CASE r {levels} ELSE 1 END)), 1) AS INTEGER) AS severity_id FROM {name}"""


class Detector(NamedTuple):
    """A detector: sensor events to records with `hits`, its records' class, and records to findings. More are added to
    DETECTORS by name."""

    class_uid: int
    records: Callable[[DataFrame], DataFrame]
    findings: Callable[[DataFrame], DataFrame]


DETECTORS = {
    "process": Detector(1007, process_records, O.process_findings),
    "network": Detector(4001, network_records, O.network_findings),
    "file": Detector(1001, file_records, O.file_findings),
}


def all_findings(events: DataFrame) -> DataFrame:
    """Findings of all detectors of single events."""
    return reduce(DataFrame.unionByName, [d.findings(d.records(events)) for d in DETECTORS.values()])


def process_findings(spark, sf):
    return O.process_findings(process_records(sensor_events(spark, sf))).select(*FINDING)


def network_findings(spark, sf):
    return O.network_findings(network_records(sensor_events(spark, sf))).select(*FINDING)


def file_findings(spark, sf):
    return O.file_findings(file_records(sensor_events(spark, sf))).select(*FINDING)


def fix_queue(spark, sf):
    return O.fix_queue(all_findings(sensor_events(spark, sf)))


def group_by_fix(spark, sf):
    g = O.group_by_fix(all_findings(sensor_events(spark, sf)))
    return g.select("remediation_key", "risk", F.array_join("closes", ";").alias("closes"), F.array_join("assets", ";").alias("assets"))


def exit_lifetimes(spark, sf):
    e = J.exit_lifetimes(sensor_events(spark, sf))
    return e.select("event_id", "asset_id", "pid", "image", "lifetime_ms", "matched", (F.size("hits") > 0).alias("short_lived"), F.col("severity_id").cast("int").alias("severity_id"))


EXITS = f"""exits AS (
  SELECT event_id, asset_id, pid, CASE WHEN pk = 'ProcessExec' THEN pi ELSE image END AS image,
         CASE WHEN pk = 'ProcessExec' THEN greatest(ts - pts, 0) END AS lifetime_ms, coalesce(pk = 'ProcessExec', false) AS matched
  FROM (SELECT *, lag(kind) OVER w AS pk, lag(ts) OVER w AS pts, lag(image) OVER w AS pi FROM sensor_events WHERE kind IN ('ProcessExec', 'ProcessExit')
        WINDOW w AS (PARTITION BY asset_id, pid ORDER BY ts, event_id)) x WHERE kind = 'ProcessExit')"""

CONTEXT = """ctx AS (
  SELECT e.*,
    (SELECT max_by(x.event_id, (x.ts, x.event_id)) FROM sensor_events x WHERE x.kind = 'ProcessExec' AND x.asset_id = e.asset_id AND x.pid = e.pid AND (x.ts, x.event_id) < (e.ts, e.event_id)) AS back,
    (SELECT max(x.ts) FROM sensor_events x WHERE x.kind = 'ProcessExit' AND x.asset_id = e.asset_id AND x.pid = e.pid AND (x.ts, x.event_id) < (e.ts, e.event_id)) AS last_exit,
    (SELECT min_by(x.event_id, (x.ts, x.event_id)) FROM sensor_events x WHERE x.kind = 'ProcessExec' AND x.asset_id = e.asset_id AND x.pid = e.pid AND x.ts BETWEEN e.ts + 1 AND e.ts + 249) AS ahead
  FROM sensor_events e WHERE kind IN ('NetConnect', 'FileWrite', 'FileOpen')),
picked AS (SELECT c.*, CASE WHEN b.event_id IS NOT NULL AND NOT (coalesce(c.last_exit >= b.ts, false) AND c.ts - c.last_exit >= 5000) THEN c.back ELSE c.ahead END AS exec_id
  FROM ctx c LEFT JOIN sensor_events b ON c.back = b.event_id),
named AS (SELECT p.event_id, p.asset_id, p.pid, p.ts, p.kind, p.daddr, p.dport, p.path, p.exec_id, x.image AS ctx_image, p.image AS own_image,
    CASE WHEN x.image IS NULL OR starts_with(regexp_extract(x.image, '[^/]*$'), regexp_extract(p.image, '[^/]*$')) THEN x.image ELSE p.image END AS image,
    coalesce(starts_with(regexp_extract(x.image, '[^/]*$'), regexp_extract(p.image, '[^/]*$')), false) AS same
  FROM picked p LEFT JOIN sensor_events x ON p.exec_id = x.event_id)"""

PARENTS = f"""parents AS (
  SELECT e.asset_id, e.event_id, e.ts, {Q.IMAGE_SEVERITY} AS own,
    (SELECT max_by(x.event_id, (x.ts, x.event_id)) FROM sensor_events x WHERE x.kind = 'ProcessExec' AND x.asset_id = e.asset_id AND x.pid = e.ppid AND (x.ts, x.event_id) < (e.ts, e.event_id)) AS back,
    (SELECT max(x.ts) FROM sensor_events x WHERE x.kind = 'ProcessExit' AND x.asset_id = e.asset_id AND x.pid = e.ppid AND (x.ts, x.event_id) < (e.ts, e.event_id)) AS last_exit
  FROM sensor_events e WHERE kind = 'ProcessExec'),
edges AS (SELECT p.asset_id, p.event_id, p.own, CASE WHEN coalesce(p.last_exit >= b.ts, false) AND p.ts - p.last_exit >= 5000 THEN NULL ELSE p.back END AS parent_id
  FROM parents p LEFT JOIN sensor_events b ON p.back = b.event_id),
up(event_id, node) AS (SELECT event_id, event_id FROM edges UNION SELECT u.event_id, e.parent_id FROM up u JOIN edges e ON u.node = e.event_id WHERE e.parent_id IS NOT NULL),
eff AS (SELECT u.event_id, max(e.own) AS effective FROM up u JOIN edges e ON u.node = e.event_id GROUP BY u.event_id),
lineage AS (SELECT e.event_id, f.effective, coalesce(p.effective, 1) > 1 AS suspicious_ancestor FROM edges e JOIN eff f USING (event_id) LEFT JOIN eff p ON e.parent_id = p.event_id)"""

#: With lineages walked up to their roots, so queries that use it are recursive.
CORRELATED = f"""{PARENTS}, {CONTEXT},
judged AS (SELECT *, exec_id IS NOT NULL AS attributed, CASE WHEN exec_id IS NULL THEN 1 WHEN same THEN effective ELSE {Q.IMAGE_SEVERITY} END AS process_severity,
    coalesce(same AND suspicious_ancestor, false) AS inherited,
    CASE WHEN kind = 'NetConnect' THEN {Q.NETWORK_SEVERITY} WHEN NOT {Q.WATCHED} THEN 1 WHEN len({Q.FILE_RULES}) = 0 THEN 1 WHEN kind = 'FileWrite' THEN 4 ELSE 3 END AS event_severity
  FROM (SELECT n.*, l.effective, l.suspicious_ancestor FROM named n LEFT JOIN lineage l ON n.exec_id = l.event_id) j),
correlated AS (SELECT event_id, asset_id, pid, ts, kind, daddr, dport, path, exec_id, attributed, image AS process, process_severity, inherited, event_severity,
    CASE WHEN process_severity > 1 AND event_severity > 1 THEN CASE kind WHEN 'NetConnect' THEN 'suspicious_process_suspicious_connection' WHEN 'FileWrite' THEN 'suspicious_process_suspicious_file_write' END END AS rule
  FROM judged WHERE kind = 'NetConnect' OR (kind = 'FileWrite' AND {Q.WATCHED}) OR (kind = 'FileOpen' AND {Q.WATCHED} AND event_severity > 1 AND attributed))"""


def correlated(spark, sf):
    c = J.correlated(sensor_events(spark, sf))
    return c.select("event_id", "asset_id", "kind", "attributed", "process", "exec_id", F.col("process_severity").cast("int").alias("process_severity"), "inherited", F.col("event_severity").cast("int").alias("event_severity"), "rule", F.col("severity_id").cast("int").alias("severity_id"))


def _chain_sql(first: str, rule: str, needs: bool) -> str:
    return f"""halves AS (SELECT * FROM correlated WHERE attributed AND ((kind = '{first}'{" AND rule IS NOT NULL" if needs else ""}) OR (kind = 'NetConnect' AND rule IS NOT NULL))),
gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY asset_id, pid, exec_id ORDER BY ts, event_id) >= 5000 THEN 1 ELSE 0 END AS g FROM halves),
epochs AS (SELECT *, sum(g) OVER (PARTITION BY asset_id, pid, exec_id ORDER BY ts, event_id) AS epoch FROM gaps),
ends AS (SELECT e.asset_id, e.pid, e.exec_id, e.epoch, e.ts, e.event_id, e.process,
    (SELECT max_by(o.event_id, (o.ts, o.event_id)) FROM halves o WHERE o.asset_id = e.asset_id AND o.pid = e.pid AND o.exec_id = e.exec_id AND o.kind <> e.kind AND (o.ts, o.event_id) < (e.ts, e.event_id)) AS other, e.kind FROM epochs e),
fired AS (SELECT e.*, row_number() OVER (PARTITION BY e.asset_id, e.pid, e.exec_id, epoch ORDER BY e.ts, e.event_id) AS r FROM ends e JOIN halves o ON o.event_id = e.other WHERE e.ts - o.ts < 5000),
chain AS (SELECT f.asset_id, f.pid, f.exec_id, f.ts, f.process, CASE WHEN f.kind = '{first}' THEN f.event_id ELSE f.other END AS first_id, CASE WHEN f.kind = '{first}' THEN f.other ELSE f.event_id END AS connect_id, '{rule}' AS rule FROM fired f WHERE r = 1),
chains AS (SELECT c.*, a.path, b.daddr, b.dport FROM chain c JOIN halves a ON c.first_id = a.event_id JOIN halves b ON c.connect_id = b.event_id)"""


_DROP = ("FileWrite", "suspicious_process_wrote_file_and_connected", True)
_EXFIL = ("FileOpen", "suspicious_process_read_sensitive_and_connected", False)


def dropper_chains(spark, sf):
    return J.dropper_chains(J.correlated(sensor_events(spark, sf))).drop("halves", "inherited")


def exfil_chains(spark, sf):
    return J.exfil_chains(J.correlated(sensor_events(spark, sf))).drop("halves", "inherited")


def correlation_records(events: DataFrame) -> DataFrame:
    """Connections and chains whose top-level rule fired, as records with hits; process and connection have their own."""
    c = cut(J.correlated(events))  # read by both parts below
    hit = F.array(F.struct(F.col("rule").alias("rule"), F.lit("").alias("reason"))).alias("hits")
    heir = F.when(F.col("inherited"), F.array(F.struct(F.lit(R.ANCESTOR).alias("rule"), F.lit("an ancestor is suspicious").alias("reason")))).otherwise(F.array().cast(R.HITS))
    process = F.concat(R.process_hits(F.col("process")), heir).alias("process_hits")
    connection = R.network_hits(F.col("daddr"), F.col("dport")).alias("connection_hits")
    cols = ["asset_id", "ts", "pid", F.col("process").alias("image"), "daddr", "dport", F.lit(True).alias("attributed"), process, connection]
    conns = c.where("kind = 'NetConnect' AND rule IS NOT NULL").select(*cols, hit)
    chains = J.detections_of_chain(J.chains(c))
    return conns.unionByName(chains.select(*cols, "hits"))


def chain_findings(spark, sf):
    return O.correlation_findings(correlation_records(sensor_events(spark, sf))).select(*FINDING)


def ancestry(spark, sf):
    a = J.ancestry(sensor_events(spark, sf))
    return a.select("asset_id", "event_id", "parent_id", F.col("own").cast("int").alias("own"), F.col("effective").cast("int").alias("effective"), "suspicious_ancestor")


QUERIES = {
    "process_rules": _rules(process_records, "image"),
    "network_rules": _rules(network_records, "daddr", "dport"),
    "file_rules": _rules(file_records, "path"),
    "process_findings": process_findings,
    "network_findings": network_findings,
    "file_findings": file_findings,
    "fix_queue": fix_queue,
    "group_by_fix": group_by_fix,
    "exit_lifetimes": exit_lifetimes,
    "correlated_activity": correlated,
    "dropper_chains": dropper_chains,
    "exfil_chains": exfil_chains,
    "chain_findings": chain_findings,
    "ancestry": ancestry,
}
_F = ", ".join(FINDING)
_E = f"WITH RECURSIVE {SENSOR_EVENTS}"
SQL = {
    "process_rules": _rules_sql("process_records", "image"),
    "network_rules": _rules_sql("network_records", "daddr", "dport"),
    "file_rules": _rules_sql("file_records", "path"),
    "process_findings": f"{_E}, {Q.RECORDS}, {Q.findings(Q.PROCESS_RAW)} SELECT {_F} FROM findings",
    "network_findings": f"{_E}, {Q.RECORDS}, {Q.findings(Q.NETWORK_RAW)} SELECT {_F} FROM findings",
    "file_findings": f"{_E}, {Q.RECORDS}, {Q.findings(Q.FILE_RAW)} SELECT {_F} FROM findings",
    "fix_queue": f"{_E}, {Q.RECORDS}, {Q.findings(Q.ALL_RAW)} SELECT remediation_key, max(risk) AS risk, count(DISTINCT vuln_id) AS closes_count, count(DISTINCT asset_id) AS assets_count, count(*) AS findings, row_number() OVER (ORDER BY max(risk) DESC, remediation_key) AS queue_rank FROM findings GROUP BY 1",
    "group_by_fix": f"{_E}, {Q.RECORDS}, {Q.findings(Q.ALL_RAW)} SELECT remediation_key, max(risk) AS risk, string_agg(DISTINCT vuln_id, ';' ORDER BY vuln_id) AS closes, string_agg(DISTINCT asset_id, ';' ORDER BY asset_id) AS assets FROM findings GROUP BY 1",
    "exit_lifetimes": f"{_E}, {EXITS} SELECT *, CAST(greatest(CASE WHEN matched THEN {Q.IMAGE_SEVERITY} ELSE 1 END, CASE WHEN short_lived THEN 3 ELSE 1 END) AS INTEGER) AS severity_id FROM (SELECT *, coalesce({Q.IMAGE_SEVERITY} > 1 AND lifetime_ms < 500, false) AS short_lived FROM exits) x",
    "correlated_activity": f"{_E}, {CORRELATED} SELECT event_id, asset_id, kind, attributed, process, exec_id, process_severity, inherited, event_severity, rule, CAST(CASE WHEN rule IS NOT NULL THEN 4 ELSE greatest(process_severity, event_severity) END AS INTEGER) AS severity_id FROM correlated",
    "dropper_chains": f"{_E}, {CORRELATED}, {_chain_sql(*_DROP)} SELECT * FROM chains",
    "exfil_chains": f"{_E}, {CORRELATED}, {_chain_sql(*_EXFIL)} SELECT * FROM chains",
    "ancestry": f"{_E}, {PARENTS} SELECT e.asset_id, e.event_id, e.parent_id, e.own, f.effective, coalesce(p.effective, 1) > 1 AS suspicious_ancestor FROM edges e JOIN eff f USING (event_id) LEFT JOIN eff p ON e.parent_id = p.event_id",
}
_raw = f"SELECT asset_id, 'correlation:' || process || '->' || daddr || ':' || dport AS vuln_id, process AS component, 'correlation' AS location, {Q.weight('correlation')} AS w, '{O.FIXES['correlation']}' AS remediation_key FROM tops"
SQL["chain_findings"] = (
    f"{_E}, {CORRELATED}, d AS (WITH {_chain_sql(*_DROP)} SELECT * FROM chains), x AS (WITH {_chain_sql(*_EXFIL)} SELECT * FROM chains), "
    "tops AS (SELECT asset_id, process, daddr, dport, [rule] AS rules FROM correlated WHERE kind = 'NetConnect' AND rule IS NOT NULL UNION ALL SELECT asset_id, process, daddr, dport, [rule] FROM d UNION ALL SELECT asset_id, process, daddr, dport, [rule] FROM x), "
    f"{Q.findings(_raw)} SELECT {_F} FROM findings"
)
