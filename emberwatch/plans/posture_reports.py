"""Queries over posture snapshots, lifecycle state, remediation logs, detection quality and activity reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.fixtures import SENSOR_EVENTS, sensor_events, table
from emberwatch.operators import asof as J
from emberwatch.operators import findings as O
from emberwatch.operators import posture as P
from emberwatch.operators import remediation as M
from emberwatch.operators import scorecard as B
from emberwatch.plans import detection as D
from emberwatch.plans import sqltext as Q
from emberwatch.sources.shared import cut

_E = f"WITH RECURSIVE {SENSOR_EVENTS}"


# Snapshots: a host a supplier, its packages from the parts it ships, its settings from its balance.
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    host = F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("asset_id")
    m = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k) for k in kv]), F.array(*kv.values()))
    sshd = s.where("s_suppkey % 5 <> 0").select(host, F.lit("sshd_config").alias("table"), F.lit(0).alias("row_no"), m(key=F.lit("PermitRootLogin"), value=F.when(F.col("s_nationkey") % 2 == 0, "no").otherwise("yes")).alias("fields"))
    defs = s.where("s_suppkey % 3 <> 0").select(host, F.lit("login_defs").alias("table"), F.lit(0).alias("row_no"), m(key=F.lit("PASS_MAX_DAYS"), value=F.when(F.col("s_suppkey") % 7 == 0, "never").otherwise((F.col("s_nationkey") * 30).cast("string"))).alias("fields"))
    names = F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("telnet"), F.lit("openssl"))).otherwise(F.array(F.lit("openssl")))
    pk = s.select(host, F.lit("packages").alias("table"), F.col("s_nationkey"), F.posexplode(names).alias("row_no", "name"))
    pk = pk.select("asset_id", "table", "row_no", m(name=F.col("name"), version=F.when(F.col("s_nationkey") % 3 == 0, "3.0.14").otherwise("3.0.2")).alias("fields"))
    return sshd.unionByName(defs).unionByName(pk)


_CONTROLS = """ctl AS (
  SELECT asset_id, 'sshd-root-login-disabled' AS control_id, s_nationkey % 2 = 0 AS passed, CAST(0.8 AS REAL) AS w, 'sshd_config' AS component, '/etc/ssh/sshd_config' AS location, 'set:PermitRootLogin=no' AS remediation_key FROM s WHERE s_suppkey % 5 <> 0
  UNION ALL SELECT asset_id, 'telnet-not-installed', s_suppkey % 4 <> 0, CAST(0.6 AS REAL), 'telnet', 'package-manager', 'remove:telnet' FROM s
  UNION ALL SELECT asset_id, 'password-max-days', s_suppkey % 7 <> 0 AND s_nationkey * 30 <= 365, CAST(0.5 AS REAL), 'login.defs', '/etc/login.defs', 'set:PASS_MAX_DAYS<=365' FROM s WHERE s_suppkey % 3 <> 0),"""
_S = "WITH s AS (SELECT 'sup-' || s_suppkey AS asset_id, s_suppkey, s_nationkey, s_acctbal FROM supplier)"


def controls(spark, sf):
    return P.evaluate_controls(snapshots(spark, sf)).select("asset_id", "control_id", "passed")


def controls_with_policy(spark, sf):
    used = P.apply_overrides(P.CONTROLS, [("telnet-not-installed", False, None), ("password-max-days", None, 0.9), ("password-max-days", False, None), ("no-such", True, 0.1)])
    return P.compliance_findings(P.evaluate_controls(snapshots(spark, sf), used)).select("finding_id", "risk", "decision", "remediation_key")


CROSSWALK = [("sshd-root-login-disabled", "CIS", "5.2.10"), ("sshd-root-login-disabled", "PCI-DSS", "2.2.4"), ("sshd-root-login-disabled", "CIS", "5.2.1"), ("telnet-not-installed", "CIS", "2.3.1"), ("password-max-days", "ISO-27001", "A.9.4.3")]


def framework_results(spark, sf):
    x = spark.createDataFrame(CROSSWALK, "control_id string, framework string, framework_control string")
    r = P.with_frameworks(P.evaluate_controls(snapshots(spark, sf)), x)
    f = r.select("control_id", "passed", F.explode("frameworks").alias("f"))
    return f.groupBy(F.col("f.framework").alias("framework"), F.array_join("f.control_ids", ",").alias("controls")).agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def compliance_findings(spark, sf):
    return P.compliance_findings(P.evaluate_controls(snapshots(spark, sf))).select(*D.FINDING)


def baseline(spark):
    return spark.createDataFrame(
        [("openssl-pinned", "packages", "name", "openssl", "version", "3.0.14", "openssl", "packages", 0.7, "upgrade:openssl=3.0.14"), ("telnet-absent", "packages", "name", "telnet", None, None, "telnet", "packages", 0.6, "remove:telnet"), ("no-table", "kernel", "name", "x", None, None, "x", "kernel", 0.1, "none")],
        "entry_id string, table string, selector_field string, selector_value string, value_field string, expected string, subject string, location string, weight double, remediation_key string",
    )


def drift_findings(spark, sf):
    return P.drift_findings(P.drift(snapshots(spark, sf), baseline(spark))).select(*D.FINDING)


def watched_files(spark, sf):
    s = table(spark, sf, "supplier")
    host = F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")).alias("asset_id")
    # Hosts whose files are none of the watched ones have lost them all.
    files = s.select(host, F.lit(0).alias("row_no"), F.when(F.col("s_suppkey") % 6 == 0, "/etc/hosts").otherwise("/etc/passwd").alias("path"), F.when(F.col("s_nationkey") % 4 == 0, "bad").otherwise("good").alias("sha256"), F.when(F.col("s_suppkey") % 8 == 0, False).alias("exists"))
    watch = spark.createDataFrame([("fim-passwd", "/etc/passwd", "good", 0.9, "investigate:/etc/passwd"), ("fim-sshd", "/etc/ssh/sshd_config", "good", 0.8, "restore:/etc/ssh/sshd_config")], "entry_id string, path string, expected_sha256 string, weight double, remediation_key string")
    return files, watch


def integrity_records(spark, sf):
    return P.integrity(*watched_files(spark, sf)).select("asset_id", "entry_id", "violated", "actual_sha256")


def change_gate(spark, sf):
    o = table(spark, sf, "orders")
    return P.change_gate(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus")


def first_sightings(spark, sf):
    return P.first_sightings(sensor_events(spark, sf).where("kind = 'FileOpen'")).select("asset_id", "path", "event_id", "ts")


# Lifecycle: the prior state is what the first two thirds of the events gave, the run reads the last two thirds.
def _events(spark, sf, last: bool):
    e = sensor_events(spark, sf)
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    low, high = low or 0, high or 0
    return e.where(F.col("ts") >= low + (high - low) // 3) if last else e.where(F.col("ts") < low + (high - low) * 2 // 3)


def _prior(spark, sf):
    e = _events(spark, sf, last=False)
    n = F.length("finding_id")
    status = F.when(n % 4 == 0, "closed").when(n % 4 == 1, "accepted").when(n % 4 == 2, "suppressed").otherwise("open")
    return D.all_findings(e).withColumns({"status": status, "first_seen": F.lit(1000).cast("long"), "last_seen": F.lit(2000).cast("long"), "closed_at": F.when(status == "closed", F.lit(2000).cast("long"))})


_NOW = 1704067300000


def lifecycle(spark, sf):
    fresh = O.reconcile(_prior(spark, sf), D.all_findings(_events(spark, sf, last=True)), F.lit(_NOW))
    return fresh.select("finding_id", "status", "first_seen", "last_seen", "closed_at")


def state_after_run(spark, sf):
    prior = cut(_prior(spark, sf))
    fresh = O.reconcile(prior, D.all_findings(_events(spark, sf, last=True)), F.lit(_NOW))
    return O.upsert(prior, O.carry_forward(fresh, prior)).select("finding_id", "status", "first_seen", "last_seen")


def _sub(where: str, name: str) -> str:
    return f"{name} AS (WITH {SENSOR_EVENTS.replace('sensor_events AS (', 'every AS (', 1)}, ends AS (SELECT min(ts) AS low, max(ts) AS high FROM every), sensor_events AS (SELECT every.* FROM every, ends WHERE {where}), {Q.RECORDS}, {Q.findings(Q.ALL_RAW)} SELECT finding_id FROM findings)"


_LIFE = f"""WITH {_sub('ts < low + (high - low) * 2 // 3', 'p0')}, {_sub('ts >= low + (high - low) // 3', 'fresh')},
prior AS (SELECT finding_id, CASE length(finding_id) % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'suppressed' ELSE 'open' END AS status FROM p0),
run AS (SELECT f.finding_id, CASE WHEN p.status = 'closed' THEN 'reopened' ELSE 'open' END AS status, CASE WHEN p.finding_id IS NULL THEN {_NOW} ELSE 1000 END AS first_seen, {_NOW} AS last_seen, CAST(NULL AS BIGINT) AS closed_at, p.status AS was FROM fresh f LEFT JOIN prior p USING (finding_id))"""


# Remediation logs: an action an order, a target an order line.
def stage_failures(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("action_id"), F.when(F.col("l_linenumber") <= 2, "canary").otherwise("rollout").alias("stage"), (F.col("l_returnflag") == "R").alias("failed"))
    return M.stage_failures(l, 0.4)


def _audit(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.array(F.lit("drafted"), F.lit("dry_run"), F.lit("pending_approval"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("aborted"), F.when(F.col("o_orderkey") % 5 == 0, "rollout").otherwise("canary")).alias("s"))
    e = o.select(F.col("o_orderkey").alias("action_id"), "s", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("seq"))
    return e.select("action_id", "seq", F.get("s", F.col("seq") - 1).alias("from_state"), F.get("s", F.col("seq")).alias("to_state"), F.when((F.col("action_id") % 11 == 0) & (F.col("seq") == 4), "rejected").otherwise("ok").alias("outcome"))


_AUDIT = """WITH o AS (SELECT o_orderkey AS action_id, ['drafted', 'dry_run', 'pending_approval', CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'aborted' END, CASE WHEN o_orderkey % 5 = 0 THEN 'rollout' ELSE 'canary' END] AS s FROM orders),
audit AS (SELECT action_id, seq, s[seq] AS from_state, s[seq + 1] AS to_state, CASE WHEN action_id % 11 = 0 AND seq = 4 THEN 'rejected' ELSE 'ok' END AS outcome FROM o, (SELECT CAST(range AS INTEGER) AS seq FROM range(1, 5)) q)"""


def action_states(spark, sf):
    return M.current_state(_audit(spark, sf))


def illegal_transitions(spark, sf):
    return M.illegal_transitions(_audit(spark, sf)).select("action_id", "seq", "from_state", "to_state")


def unauthorized_commands(spark, sf):
    o = table(spark, sf, "orders")
    kinds = F.array(*[F.lit(k) for k in ("draft", "approve", "canary", "abort", "rollback")])
    c = o.select(F.col("o_orderkey").alias("command_id"), F.concat(F.lit("actor-"), (F.col("o_custkey") % 5).cast("string")).alias("actor"), F.get(kinds, (F.col("o_orderkey") % 5).cast("int")).alias("kind"))
    r = spark.createDataFrame([("actor-0", "admin"), ("actor-1", "operator"), ("actor-2", "approver"), ("actor-3", "responder")], "actor string, role string")
    return M.unauthorized_commands(c, r).groupBy("actor", "kind").agg(F.count("*").alias("denied"))


def schedule_status(spark, sf):
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.groupBy(M.schedule_status(day, day + 30, F.lit(1000)).alias("status")).agg(F.count("*").alias("actions"))


def replay_audit(spark, sf):
    o = table(spark, sf, "orders")
    c = o.select(F.concat(F.lit("s-"), F.col("o_custkey").cast("string")).alias("session"), (F.col("o_orderkey") % 97).alias("seq"), F.col("o_orderkey").alias("arrival"))
    s = o.where("o_custkey % 4 <> 0").select(F.concat(F.lit("s-"), F.col("o_custkey").cast("string")).alias("session"), F.lit(10).cast("long").alias("open_from")).distinct()
    return M.replay_audit(c, s).select("session", "arrival", "seq", "accepted")


def command_results(spark, sf):
    o = table(spark, sf, "orders")
    # Some commands and some results are of sessions that the other side doesn't know.
    c = o.select((F.col("o_custkey") % 50 + F.when(F.col("o_orderkey") % 3 == 0, 100).otherwise(0)).alias("session"), F.col("o_orderkey").alias("seq"))
    l = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    r = l.select((F.col("o_custkey") % 50 + F.when(F.col("l_orderkey") % 7 == 0, 200).otherwise(0)).alias("session"), F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("arrival"))
    return M.match_results(c, r).groupBy("status").agg(F.count("*").alias("rows"))


def fix_verification(spark, sf):
    f = D.all_findings(sensor_events(spark, sf))
    links = f.select(F.concat(F.lit("fix-"), (F.length("finding_id") % 7).cast("string")).alias("action_id"), "finding_id")
    return M.verify_fixes(links, f.where("NOT startswith(finding_id, 'host-1') AND asset_id <> 'host-2'").where(F.length("finding_id") % 7 != 3))


# Activity reports.
def activity_by_day(spark, sf):
    e = sensor_events(spark, sf)
    r = None
    for name, detector in D.DETECTORS.items():
        p = detector.records(e).where(F.size("hits") > 0).select("ts", F.lit(name).alias("category"))
        r = p if r is None else r.unionByName(p)
    day = F.window(F.timestamp_millis("ts"), "1 day")
    return r.groupBy(day.alias("w"), "category").agg(F.count("*").alias("detections")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "category", "detections")


def chains_by_rule(spark, sf):
    return J.chains(J.correlated(sensor_events(spark, sf))).groupBy("rule").agg(F.count("*").alias("chains"), F.countDistinct("asset_id").alias("hosts"))


def top_images(spark, sf):
    return sensor_events(spark, sf).where("kind = 'ProcessExec'").groupBy("image").agg(F.count("*").alias("execs"), F.countDistinct("asset_id").alias("hosts")).orderBy(F.desc("execs"), "image").limit(5)


def host_coverage(spark, sf):
    return sensor_events(spark, sf).groupBy("asset_id").agg(F.count("*").alias("records"), F.max("ts").alias("last_seen"))


def risk_bands(spark, sf):
    f = D.all_findings(sensor_events(spark, sf))
    return f.groupBy("decision", "status").agg(F.count("*").alias("findings"), F.max("risk").alias("top"))


def weekly_backlog(spark, sf):
    """Opened and closed per week, and what is open after it."""
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("first_seen"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 20 DAYS")).alias("closed_at"))
    week = lambda c: F.date_format(F.date_trunc("week", c), "yyyy-MM-dd")
    a = o.groupBy(week(F.col("first_seen")).alias("week")).agg(F.count("*").alias("opened"))
    b = o.where("closed_at IS NOT NULL").groupBy(week(F.col("closed_at")).alias("week")).agg(F.count("*").alias("closed"))
    j = a.join(b, "week", "full_outer").na.fill(0, ["opened", "closed"])
    # One row a week: the running sum is over few rows, whatever the number of findings.
    return j.withColumn("backlog", F.sum(F.col("opened") - F.col("closed")).over(Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)))


def mean_time_to_fix(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("decision"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("first_seen"), F.when(F.col("o_orderstatus") == "F", F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 40 * 86400000).alias("closed_at"))
    return O.mttr_days(o).groupBy("decision").agg(F.round(F.avg("mttr_days"), 6).alias("mttr_days"), F.count("mttr_days").alias("closed"))


# Detection quality: a case a customer, its records from the orders.
def _bench(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    k = F.col("c_custkey")
    cases = c.select(
        k.alias("case_id"), F.when(k % 3 == 0, "B").otherwise("A").alias("tier"), F.concat(F.lit("T"), (k % 4).cast("string"), F.when(k % 5 == 0, "+T9").otherwise("")).alias("technique"),
        F.when(k % 6 == 0, "miss").otherwise("hit").alias("expected_result"), F.when(k % 10 != 9, F.lit(1007)).alias("want_class"), F.when(k % 10 != 9, F.concat(F.lit("rule-"), (k % 4).cast("string"))).alias("want_rule"),
        F.lit(5.0).alias("seconds"), k.alias("case_no"),
    )
    captures = c.where("c_custkey % 13 <> 0").select(k.alias("case_id"), F.lit(1000).cast("long").alias("trigger"))
    records = o.select(F.col("o_custkey").alias("case_id"), F.when(F.col("o_orderkey") % 3 == 0, 4001).otherwise(1007).alias("class_uid"), F.when(F.col("o_orderkey") % 17 != 0, (F.lit(500) + F.col("o_orderkey") % 7000)).cast("long").alias("time"), F.array(F.concat(F.lit("rule-"), (F.col("o_orderkey") % 4).cast("string"))).alias("rules"))
    return cases, captures, records


_BENCH = """WITH cases AS (SELECT c_custkey AS case_id, CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE 'A' END AS tier, 'T' || (c_custkey % 4) || CASE WHEN c_custkey % 5 = 0 THEN '+T9' ELSE '' END AS technique,
  CASE WHEN c_custkey % 6 = 0 THEN 'miss' ELSE 'hit' END AS expected, CASE WHEN c_custkey % 10 <> 9 THEN 'rule-' || (c_custkey % 4) END AS want, c_custkey % 13 <> 0 AS captured FROM customer),
recs AS (SELECT o_custkey AS case_id, CASE WHEN o_orderkey % 3 = 0 THEN 4001 ELSE 1007 END AS class, CASE WHEN o_orderkey % 17 <> 0 THEN 500 + o_orderkey % 7000 END AS t, 'rule-' || (o_orderkey % 4) AS rule FROM orders),
firsts AS (SELECT want AS rule, min_by(technique, case_id) AS rtech FROM cases WHERE want IS NOT NULL GROUP BY 1),
j AS (SELECT c.*, r.class, r.t, r.rule, CASE WHEN c.want IS NULL THEN true WHEN NOT captured THEN r.rule IS NULL ELSE coalesce(r.t BETWEEN 1000 AND 6000, true) END AS inside FROM cases c LEFT JOIN recs r USING (case_id)),
v AS (SELECT case_id, tier, technique, expected, want, captured, bool_or(coalesce(inside AND class = 1007 AND rule = want, false)) AS hit, bool_or(coalesce(inside AND class = 1007 AND want IS NOT NULL, false)) AS seen,
   min(CASE WHEN inside AND class = 1007 AND rule = want AND captured THEN greatest(t - 1000, 0) END) AS latency_ms FROM j GROUP BY ALL),
x AS (SELECT j.case_id, string_agg(DISTINCT j.rule, ',' ORDER BY j.rule) AS fp FROM j JOIN firsts f ON j.rule = f.rule WHERE inside AND captured AND (j.want IS NULL OR j.rule <> j.want) AND NOT list_has_any(string_split(technique, '+'), string_split(rtech, '+')) GROUP BY 1),
verdicts AS (SELECT v.case_id, tier, technique, CASE WHEN NOT captured THEN 'NO_DATA' WHEN want IS NULL THEN 'GAP' WHEN expected = 'miss' THEN CASE WHEN hit THEN 'GAP_CLOSED' ELSE 'GAP' END WHEN hit THEN 'HIT' WHEN seen THEN 'PARTIAL' ELSE 'MISS' END AS verdict, latency_ms, coalesce(fp, '') AS fp_rules FROM v LEFT JOIN x USING (case_id))"""


def case_verdicts(spark, sf):
    cases, captures, records = _bench(spark, sf)
    v = B.score_cases(cases, captures, records.join(captures.select("case_id"), "case_id", "left_semi"))
    return v.select("case_id", "tier", "technique", "verdict", "latency_ms", F.array_join("fp_rules", ",").alias("fp_rules"))


def detection_coverage(spark, sf):
    cases, captures, records = _bench(spark, sf)
    return B.coverage(B.score_cases(cases, captures, records.join(captures.select("case_id"), "case_id", "left_semi")))


def latency_by_class(spark, sf):
    return B.latency_by_class(*_bench(spark, sf))


def conformance(spark, sf):
    o = table(spark, sf, "orders")
    classes = F.array(*[F.lit(c) for c in (1007, 4001, 9005, 5020, 1)])
    e = o.select(F.get(classes, (F.col("o_orderkey") % 5).cast("int")).alias("class_uid"), F.lit("x").alias("class_name"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey")).alias("time"), (F.col("o_orderkey") % 8).alias("severity_id"), F.lit("m").alias("metadata"), F.lit("d").alias("device"), F.lit("{}").alias("data"))
    return B.conformance(B.violations(e))


QUERIES = {
    "posture_controls": controls,
    "posture_policy": controls_with_policy,
    "framework_results": framework_results,
    "compliance_findings": compliance_findings,
    "drift_findings": drift_findings,
    "integrity_records": integrity_records,
    "change_gate": change_gate,
    "first_sightings": first_sightings,
    "lifecycle": lifecycle,
    "state_after_run": state_after_run,
    "stage_failures": stage_failures,
    "action_states": action_states,
    "illegal_transitions": illegal_transitions,
    "unauthorized_commands": unauthorized_commands,
    "schedule_status": schedule_status,
    "replay_audit": replay_audit,
    "command_results": command_results,
    "fix_verification": fix_verification,
    "activity_by_day": activity_by_day,
    "chains_by_rule": chains_by_rule,
    "top_images": top_images,
    "host_coverage": host_coverage,
    "risk_bands": risk_bands,
    "weekly_backlog": weekly_backlog,
    "mean_time_to_fix": mean_time_to_fix,
    "case_verdicts": case_verdicts,
    "detection_coverage": detection_coverage,
    "latency_by_class": latency_by_class,
    "conformance": conformance,
}
_F = ", ".join(D.FINDING)
_POLICY = "SELECT asset_id, control_id AS vuln_id, component, location, CASE control_id WHEN 'password-max-days' THEN CAST(0.9 AS REAL) ELSE w END AS w, remediation_key FROM ctl WHERE NOT passed AND control_id <> 'telnet-not-installed'"
_C = "SELECT asset_id, control_id AS vuln_id, component, location, w, remediation_key FROM ctl WHERE NOT passed"
_DR = "SELECT asset_id, 'openssl-pinned' AS vuln_id, 'openssl' AS component, 'packages' AS location, CAST(0.7 AS REAL) AS w, 'upgrade:openssl=3.0.14' AS remediation_key FROM s WHERE s_nationkey % 3 <> 0 UNION ALL SELECT asset_id, 'telnet-absent', 'telnet', 'packages', CAST(0.6 AS REAL), 'remove:telnet' FROM s WHERE s_suppkey % 4 = 0"
_KIND = "['draft', 'approve', 'canary', 'abort', 'rollback'][1 + o_orderkey % 5]"
SQL = {
    "posture_controls": f"{_S}, {_CONTROLS[:-1]} SELECT asset_id, control_id, passed FROM ctl",
    "posture_policy": f"{_S}, {_CONTROLS} {Q.findings(_POLICY)} SELECT finding_id, risk, decision, remediation_key FROM findings",
    "framework_results": f"{_S}, {_CONTROLS[:-1]} SELECT f AS framework, c AS controls, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM ctl JOIN (VALUES ('sshd-root-login-disabled', 'CIS', '5.2.1,5.2.10'), ('sshd-root-login-disabled', 'PCI-DSS', '2.2.4'), ('telnet-not-installed', 'CIS', '2.3.1'), ('password-max-days', 'ISO-27001', 'A.9.4.3')) x(i, f, c) ON control_id = i GROUP BY 1, 2",
    "compliance_findings": f"{_S}, {_CONTROLS} {Q.findings(_C)} SELECT {_F} FROM findings",
    "drift_findings": f"{_S}, {Q.findings(_DR)} SELECT {_F} FROM findings",
    "integrity_records": f"{_S}, f AS (SELECT * FROM s), a AS (SELECT asset_id, 'fim-passwd' AS entry_id, CASE WHEN s_suppkey % 8 = 0 OR s_suppkey % 6 = 0 THEN '<deleted>' WHEN s_nationkey % 4 = 0 THEN 'bad' ELSE 'good' END AS actual_sha256 FROM f UNION ALL SELECT asset_id, 'fim-sshd', '<deleted>' FROM f) SELECT asset_id, entry_id, actual_sha256 <> 'good' AS violated, actual_sha256 FROM a",
    "change_gate": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS DISTINCT FROM o_orderstatus",
    "first_sightings": f"{_E} SELECT asset_id, path, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM sensor_events WHERE kind = 'FileOpen' GROUP BY 1, 2",
    "lifecycle": f"{_LIFE} SELECT finding_id, status, first_seen, last_seen, closed_at FROM run",
    "state_after_run": f"{_LIFE} SELECT finding_id, CASE WHEN was IN ('accepted', 'suppressed') THEN was ELSE status END AS status, first_seen, last_seen FROM run UNION ALL SELECT finding_id, status, 1000, 2000 FROM prior WHERE finding_id NOT IN (SELECT finding_id FROM run)",
    "stage_failures": "SELECT *, rate > 0.4 AS rolled_back FROM (SELECT l_orderkey AS action_id, CASE WHEN l_linenumber <= 2 THEN 'canary' ELSE 'rollout' END AS stage, count(*) AS attempted, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'R') / CAST(count(*) AS DOUBLE) AS rate FROM lineitem GROUP BY 1, 2)",
    "action_states": f"{_AUDIT} SELECT action_id, max_by(to_state, seq) AS state, max(seq) AS seq FROM audit WHERE outcome <> 'rejected' GROUP BY 1",
    "illegal_transitions": f"{_AUDIT} SELECT action_id, seq, from_state, to_state FROM audit WHERE outcome <> 'rejected' AND seq = 4 AND (from_state = 'aborted' OR to_state <> 'canary')",
    "unauthorized_commands": f"SELECT actor, kind, count(*) AS denied FROM (SELECT 'actor-' || (o_custkey % 5) AS actor, {_KIND} AS kind FROM orders) c WHERE NOT (actor = 'actor-0' OR (actor = 'actor-1' AND kind IN ('draft', 'canary', 'rollback')) OR (actor = 'actor-2' AND kind = 'approve') OR (actor = 'actor-3' AND kind = 'abort')) GROUP BY 1, 2",
    "schedule_status": "SELECT CASE WHEN 1000 > d + 30 THEN 'expired' WHEN 1000 < d THEN 'pending' ELSE 'open' END AS status, count(*) AS actions FROM (SELECT date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders) GROUP BY 1",
    "replay_audit": "SELECT session, arrival, seq, o_custkey % 4 <> 0 AND seq > greatest(10, coalesce(m, 10)) AS accepted FROM (SELECT *, max(seq) OVER (PARTITION BY session ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT 's-' || o_custkey AS session, o_custkey, o_orderkey % 97 AS seq, o_orderkey AS arrival FROM orders) a) b",
    "command_results": "WITH c AS (SELECT o_custkey % 50 + CASE WHEN o_orderkey % 3 = 0 THEN 100 ELSE 0 END AS session, o_orderkey AS seq FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY arrival) AS nth FROM (SELECT o_custkey % 50 + CASE WHEN l_orderkey % 7 = 0 THEN 200 ELSE 0 END AS session, l_orderkey AS seq, l_linenumber AS arrival FROM lineitem JOIN orders ON l_orderkey = o_orderkey) x) SELECT CASE WHEN r.nth IS NULL THEN 'outstanding' WHEN c.seq IS NULL THEN 'unknown' WHEN nth > 1 THEN 'repeat' ELSE 'accepted' END AS status, count(*) AS rows FROM c FULL JOIN r ON c.session = r.session AND c.seq = r.seq GROUP BY 1",
    "fix_verification": f"{_E}, {Q.RECORDS}, {Q.findings(Q.ALL_RAW)}, l AS (SELECT 'fix-' || (length(finding_id) % 7) AS action_id, NOT starts_with(finding_id, 'host-1') AND asset_id <> 'host-2' AND length(finding_id) % 7 <> 3 AS still FROM findings) SELECT action_id, count(*) AS linked, count(*) FILTER (still) AS remaining, count(*) FILTER (still) = 0 AS fixed FROM l GROUP BY 1",
    "activity_by_day": f"{_E}, {Q.RECORDS}, a AS (SELECT ts, 'process' AS category FROM process_records WHERE len(rules) > 0 UNION ALL SELECT ts, 'network' FROM network_records WHERE len(rules) > 0 UNION ALL SELECT ts, 'file' FROM file_records) SELECT strftime(epoch_ms(ts), '%Y-%m-%d') AS day, category, count(*) AS detections FROM a GROUP BY 1, 2",
    "chains_by_rule": f"{_E}, {D.CORRELATED}, d AS (WITH {D._chain_sql(*D._DROP)} SELECT * FROM chains), x AS (WITH {D._chain_sql(*D._EXFIL)} SELECT * FROM chains) SELECT rule, count(*) AS chains, count(DISTINCT asset_id) AS hosts FROM (SELECT rule, asset_id FROM d UNION ALL SELECT rule, asset_id FROM x) u GROUP BY 1",
    "top_images": f"{_E} SELECT image, count(*) AS execs, count(DISTINCT asset_id) AS hosts FROM sensor_events WHERE kind = 'ProcessExec' GROUP BY 1 ORDER BY execs DESC, image LIMIT 5",
    "host_coverage": f"{_E} SELECT asset_id, count(*) AS records, max(ts) AS last_seen FROM sensor_events GROUP BY 1",
    "risk_bands": f"{_E}, {Q.RECORDS}, {Q.findings(Q.ALL_RAW)} SELECT decision, status, count(*) AS findings, max(risk) AS top FROM findings GROUP BY 1, 2",
    "weekly_backlog": "WITH a AS (SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS opened FROM orders GROUP BY 1), b AS (SELECT strftime(date_trunc('week', o_orderdate + INTERVAL 20 DAY), '%Y-%m-%d') AS week, count(*) AS closed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), j AS (SELECT coalesce(a.week, b.week) AS week, coalesce(opened, 0) AS opened, coalesce(closed, 0) AS closed FROM a FULL JOIN b ON a.week = b.week) SELECT *, CAST(sum(opened - closed) OVER (ORDER BY week) AS BIGINT) AS backlog FROM j",
    "mean_time_to_fix": "SELECT o_orderpriority AS decision, round(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 40 AS DOUBLE) END), 6) AS mttr_days, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders GROUP BY 1",
    "case_verdicts": f"{_BENCH} SELECT * FROM verdicts",
    "detection_coverage": f"{_BENCH} SELECT *, round(1000.0 * hits / total) / 10.0 AS coverage_pct FROM (SELECT count(*) FILTER (tier = 'A') AS total, count(*) FILTER (tier = 'A' AND verdict = 'HIT') AS hits, count(*) FILTER (verdict = 'GAP_CLOSED') AS gaps_closed, CAST(sum(CASE WHEN fp_rules = '' THEN 0 ELSE len(string_split(fp_rules, ',')) END) AS BIGINT) AS cross_technique FROM verdicts) q",
    "latency_by_class": f"{_BENCH}, l AS (SELECT case_id, min(greatest(t - 1000, 0)) AS ms FROM cases JOIN recs USING (case_id) WHERE captured AND want IS NOT NULL AND class = 1007 AND rule = want AND t IS NOT NULL GROUP BY 1), a AS (SELECT list_sort(list(ms)) AS v, count(*) AS n FROM l) SELECT 1007 AS class_uid, CAST(n AS INTEGER) AS n, CAST(CASE WHEN n % 2 = 1 THEN v[n // 2 + 1] ELSE (v[n // 2] + v[n // 2 + 1]) // 2 END AS BIGINT) AS median_ms, CAST(v[CAST(round(0.95 * (n - 1)) AS BIGINT) + 1] AS BIGINT) AS p95_ms FROM a",
    "conformance": "SELECT class_uid, count(*) AS total, count(*) FILTER (ok) AS passed, round(1000.0 * count(*) FILTER (ok) / count(*)) / 10.0 AS pct FROM (SELECT c AS class_uid, k % 9 <> 0 AND k % 8 BETWEEN 1 AND 6 AND c NOT IN (9005, 1) AS ok FROM (SELECT o_orderkey AS k, [1007, 4001, 9005, 5020, 1][1 + o_orderkey % 5] AS c FROM orders) a) b GROUP BY 1",
}
