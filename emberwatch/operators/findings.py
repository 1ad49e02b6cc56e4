"""From detections to scored, deduplicated findings with a lifecycle, and to groups by fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.functions import scoring as S
from emberwatch.sources.shared import cut

# How much a rule matters, by kind of activity; rules that are not listed weigh UNKNOWN_RULE.
WEIGHTS = {
    "process": {"lolbin": 0.4, "suspicious_path": 0.4, "lolbin_in_suspicious_path": 0.7, "short_lived_suspicious": 0.5},
    "network": {"suspicious_port": 0.4, "suspicious_port_to_external": 0.7},
    "file": {"write_to_system_dir": 0.8, "write_to_persistence_location": 0.8, "write_to_sensitive_config": 0.8, "read_of_sensitive_file": 0.5},
    "correlation": {
        "suspicious_process_suspicious_connection": 0.9, "suspicious_process_wrote_file_and_connected": 0.95,
        "suspicious_process_read_sensitive_and_connected": 0.95,
    },
}
UNKNOWN_RULE = 0.3
FIXES = {"process": "triage-suspicious-process", "network": "triage-suspicious-connection", "file": "triage-suspicious-file-activity", "correlation": "triage-attack-chain"}
IDENTITY = ["asset_id", "vuln_id", "component", "location"]
FINDING = "finding_id string, asset_id string, vuln_id string, component string, location string, risk int, decision string, sla_hours int, status string, remediation_key string, first_seen long, last_seen long, closed_at long"


def rule_weight(rule: Column, weights: dict[str, float]) -> Column:
    return S.lookup(rule, weights, UNKNOWN_RULE)


def strongest_rule(found: Column, weights: dict[str, float]) -> Column:
    """Greatest weight over an array of (rule, reason); null where it is empty."""
    return F.array_max(F.transform(found, lambda h: rule_weight(h["rule"], weights)))


def with_context(findings: DataFrame, assets: DataFrame | None) -> DataFrame:
    """Adds internet_facing, criticality and compensating_controls; hosts without a row are internal and normal.
    `assets` has a row a host; the planner broadcasts it where it is small."""
    names = {"internet_facing": F.lit(False), "criticality": F.lit("normal"), "compensating_controls": F.lit(False)}
    if assets is None:
        return findings.withColumns(names)
    joined = findings.join(assets.select("asset_id", *names), "asset_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), v) for k, v in names.items()})


def weighted_findings(contributions: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """One finding per identity from (identity, weight, remediation_key), scored by the greatest weight. The sum over
    records is a partial aggregate, so a busy host costs a row a task."""
    one = contributions.groupBy(*IDENTITY, "remediation_key").agg(F.max("weight").alias("weight"))
    e = with_context(one, assets).withColumn("explain", S.policy_explain(F.col("weight"), F.col("internet_facing"), F.col("compensating_controls"), F.col("criticality")))
    e = e.withColumn("risk", S.policy_risk(F.col("explain")))
    made = S.decision(F.col("risk"))
    return e.select(
        S.finding_id(*[F.col(c) for c in IDENTITY]).alias("finding_id"), *IDENTITY, "risk", "explain", made.alias("decision"), S.sla_hours(made).alias("sla_hours"),
        F.lit("open").alias("status"), "remediation_key", *[F.lit(None).cast("long").alias(c) for c in ("first_seen", "last_seen", "closed_at")],
    )


CONTRIBUTIONS = "array<struct<vuln_id:string,component:string,location:string,weight:float,remediation_key:string>>"


def contribution(vuln_id: Column, component: Column, location: Column, weight: Column, fix: Column) -> Column:
    """What a record adds to a finding of its host."""
    return F.struct(vuln_id.alias("vuln_id"), component.alias("component"), location.alias("location"), weight.cast("float").alias("weight"), fix.alias("remediation_key"))


def _of(kind: str, key: Column, component: Column, location: Column) -> Column:
    return contribution(F.concat(F.lit(f"{kind}:"), key), component, location, strongest_rule(F.col("hits"), WEIGHTS[kind]), F.lit(FIXES[kind]))


def process_contribution() -> Column:
    """Per image; null without hits. These read the columns image, daddr, dport, path and hits."""
    image = F.coalesce("image", F.lit(""))
    return F.when(F.size("hits") > 0, _of("process", image, image, F.lit("process")))


def _address() -> tuple[Column, Column]:
    return F.col("daddr").isNotNull() & F.col("dport").isNotNull(), F.concat(F.col("daddr"), F.lit(":"), F.pmod(F.col("dport").cast("long"), F.lit(65536)).cast("string"))


def network_contribution() -> Column:
    """Per daddr:dport; null without either."""
    known, address = _address()
    return F.when((F.size("hits") > 0) & known, _of("network", address, F.col("daddr"), F.lit("network")))


def file_contribution() -> Column:
    """Per path."""
    return F.when((F.size("hits") > 0) & F.col("path").isNotNull(), _of("file", F.col("path"), F.col("path"), F.col("path")))


def correlation_contribution() -> Column:
    """Per image->daddr:dport of top-level hits; null for chains without a connection."""
    known, address = _address()
    key = F.concat(F.col("image"), F.lit("->"), address)
    return F.when((F.size("hits") > 0) & known & F.col("image").isNotNull(), _of("correlation", key, F.substring_index(key, "->", 1), F.lit("correlation")))


def _findings(records: DataFrame, made: Column, assets: DataFrame | None) -> DataFrame:
    return weighted_findings(records.select("asset_id", made.alias("c")).where("c IS NOT NULL").select("asset_id", "c.*"), assets)


def process_findings(records: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Per (asset_id, image) of records with `hits`."""
    return _findings(records, process_contribution(), assets)


def network_findings(records: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Per (asset_id, daddr:dport); records without either contribute nothing."""
    return _findings(records, network_contribution(), assets)


def file_findings(records: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Per (asset_id, path)."""
    return _findings(records, file_contribution(), assets)


def correlation_findings(records: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Per (asset_id, image->daddr:dport) from top-level hits; chains without a connection yield nothing."""
    return _findings(records, correlation_contribution(), assets)


def correlate(detections: DataFrame) -> DataFrame:
    """One row per identity from detections (identity, source, method, confidence, remediation_key, seq): provenance by
    falling confidence, in input order on ties, and the fix of the first; and all `versions`, where detections have them."""
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions")))).alias("versions")] if "versions" in detections.columns else []
    item = F.struct((-F.col("confidence")).alias("order"), "seq", "source", "method", "confidence", "remediation_key")
    g = detections.groupBy(*IDENTITY).agg(F.sort_array(F.collect_list(item)).alias("p"), *more)
    return g.select(*IDENTITY, *[c for c in ("versions",) if more], F.transform("p", lambda x: F.struct(x["source"].alias("source"), x["method"].alias("method"), x["confidence"].alias("confidence"))).alias("provenance"), F.get("p", 0)["remediation_key"].alias("remediation_key"))


def fix_members(findings: DataFrame) -> DataFrame:
    """Per remediation key a row for each distinct vulnerability and each distinct asset (kind, member), the long form of
    group_by_fix() for fixes that touch very many hosts. Suppressed findings stay out."""
    live = findings.where(F.col("status") != "suppressed")
    both = F.array(F.struct(F.lit("closes").alias("kind"), F.col("vuln_id").alias("member")), F.struct(F.lit("asset").alias("kind"), F.col("asset_id").alias("member")))
    return live.select("remediation_key", F.explode(both).alias("m")).select("remediation_key", "m.kind", "m.member").distinct()


#: Members of a slice of a fix, about.
SLICE = 10_000


def fix_slices(findings: DataFrame, size: int = SLICE) -> DataFrame:
    """The lists of group_by_fix() in numbered slices: remediation_key, kind, slice (from 0), slices, total (members of the
    kind, exact), members (sorted). A fix that touches very many hosts is as many rows as they need; a member's slice comes
    from its hash and the number of members, so no task gets more than one slice's worth of a fix, about `size`."""
    m = cut(fix_members(findings))
    totals = cut(m.groupBy("remediation_key", "kind").agg(F.count("*").alias("total")).withColumn("slices", F.ceil(F.col("total") / size).cast("int")))
    dealt = m.join(totals, ["remediation_key", "kind"]).withColumn("slice", F.pmod(F.xxhash64("member"), F.col("slices")).cast("int"))
    return dealt.groupBy("remediation_key", "kind", "slice", "slices", "total").agg(F.array_sort(F.collect_list("member")).alias("members"))


def group_by_fix(findings: DataFrame) -> DataFrame:
    """Per remediation key: greatest risk, sorted distinct vulnerabilities and assets. Suppressed findings stay out. For
    reports that want the lists in one row, which a fix of a whole fleet makes long: fix_queue() has the numbers alone,
    and fix_slices() the lists in bounded rows; whole runs give the queue."""
    live = findings.where(F.col("status") != "suppressed")
    return live.groupBy("remediation_key").agg(F.max("risk").alias("risk"), F.array_sort(F.collect_set("vuln_id")).alias("closes"), F.array_sort(F.collect_set("asset_id")).alias("assets"))


def fix_queue(findings: DataFrame, closes: bool = False) -> DataFrame:
    """Fixes with exact distinct counts, ranked by falling risk, then key (`queue_rank`, from 1). A key's findings are
    first reduced to its distinct members, so that a fix of very many findings is spread by member. With `closes` the sorted
    vulnerabilities of a fix come along, which grow with the advisories that it answers and not with the hosts."""
    live = findings.where(F.col("status") != "suppressed")
    members = F.array(F.struct(F.lit(0).alias("kind"), F.col("vuln_id").alias("member")), F.struct(F.lit(1).alias("kind"), F.col("asset_id").alias("member")))
    one = live.select("remediation_key", "risk", F.explode(members).alias("m")).groupBy("remediation_key", "m").agg(F.max("risk").alias("risk"), F.count("*").alias("n"))
    kind = lambda k: F.col("m.kind") == k
    lists = [F.array_sort(F.collect_list(F.when(kind(0), F.col("m.member")))).alias("closes")] if closes else []
    g = one.groupBy("remediation_key").agg(F.max("risk").alias("risk"), F.count_if(kind(0)).alias("closes_count"), F.count_if(kind(1)).alias("assets_count"), F.sum(F.when(kind(0), F.col("n"))).alias("findings"), *lists)
    return ranked(g)


def ranked(fixes: DataFrame) -> DataFrame:
    """By falling risk, then key, with `queue_rank`. There are few fixes: a row a remediation key."""
    fixes = cut(fixes)  # read twice
    # Ranks are counted from the risks above (101 values), so only rows of equal risk are ordered among each other.
    above = fixes.groupBy("risk").agg(F.count("*").alias("same")).withColumn("above", F.coalesce(F.sum("same").over(Window.orderBy(F.desc("risk")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("risk").orderBy("remediation_key"))
    return fixes.join(above.drop("same"), "risk").withColumn("queue_rank", (F.col("above") + within).cast("long")).drop("above").select(*fixes.columns, "queue_rank").orderBy("queue_rank")


def batch_time(envelopes: DataFrame) -> DataFrame:
    """One row: the greatest record time, 0 for none."""
    return envelopes.agg(F.coalesce(F.max("time"), F.lit(0)).cast("long").alias("batch_time"))


def reconcile(prior: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Fresh findings after a look at the prior state, by id: first_seen is kept, last_seen moves on, and an open finding
    whose prior one was closed is reopened. Prior findings that are absent now are no concern of a run; they stay in the
    state as they are (see upsert). One left join on the id."""
    p = prior.select("finding_id", F.struct("status", "first_seen").alias("p"))
    j = fresh.join(p, "finding_id", "left")
    back = (F.col("status") == "open") & (F.col("p.status") == "closed")
    changed = {
        "status": F.when(back, "reopened").otherwise(F.col("status")),
        "first_seen": F.coalesce("p.first_seen", now),
        "last_seen": now,
        "closed_at": F.when(back, F.lit(None).cast("long")).otherwise(F.col("closed_at")),
    }
    return j.select(*[changed[c].cast("string" if c == "status" else "long").alias(c) if c in changed else F.col(c) for c in fresh.columns])


def carry_forward(report: DataFrame, prior: DataFrame) -> DataFrame:
    """Keeps what operators decided: accepted and suppressed findings of the prior state stay so. Runs after grouping,
    so an accepted finding is still in this run's queue."""
    kept = prior.where(F.col("status").isin("accepted", "suppressed")).select("finding_id", F.col("status").alias("kept"))
    return report.join(kept, "finding_id", "left").withColumn("status", F.coalesce("kept", "status")).drop("kept").select(*report.columns)


def upsert(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """State after a run: fresh rows replace those of their id (the last one, by `seq` if there is one), others stay."""
    if "seq" in fresh.columns:
        last = Window.partitionBy("finding_id").orderBy(F.desc("seq"))
        fresh = fresh.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "seq")
    return prior.join(fresh.select("finding_id"), "finding_id", "left_anti").unionByName(fresh)


def close_on_verified_fix(findings: DataFrame, verified: DataFrame) -> DataFrame:
    """Findings linked to an action verified as fixed become closed at its time. `verified`: finding_id, closed_at."""
    v = verified.groupBy("finding_id").agg(F.min("closed_at").alias("_at"))
    j = findings.join(v, "finding_id", "left")
    hit = F.col("_at").isNotNull()
    return j.withColumns({"status": F.when(hit, "closed").otherwise(F.col("status")), "closed_at": F.when(hit, F.col("_at")).otherwise(F.col("closed_at"))}).select(*findings.columns)


def mttr_days(findings: DataFrame) -> DataFrame:
    return findings.withColumn("mttr_days", (F.col("closed_at") - F.col("first_seen")) / F.lit(86400000.0))


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)
