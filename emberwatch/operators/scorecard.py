"""Detection-quality reports over declared cases and captured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.sources.shared import cut

# Fixed values.
CLASSES = {
    1001: "file_activity", 1007: "process_activity", 2002: "vulnerability", 2003: "compliance", 2004: "file_integrity", 4001: "network",
    5001: "inventory", 5002: "drift", 5020: "sbom", 9001: "health", 9002: "correlated", 9003: "library_load", 9004: "ai_inventory",
}


def in_window(time: Column, trigger: Column, seconds: Column) -> Column:
    """Between the trigger and `seconds` later, both ends included; records without a time stay."""
    return F.coalesce(time.between(trigger, trigger + (seconds * 1000).cast("long")), F.lit(True))


def score_cases(cases: DataFrame, captures: DataFrame, records: DataFrame) -> DataFrame:
    """Verdict, first-hit latency and cross-technique rules of each case.

    `cases`: case_id, tier, technique, expected_result, want_class, want_rule (both null for a declared gap), seconds,
    case_no; `captures`: case_id, trigger; `records`: case_id, class_uid, time, rules. Cases are joined with their records
    by id; everything else is conditional aggregation.
    """
    first = Window.partitionBy("want_rule").orderBy("case_no")
    techniques = cases.where("want_rule IS NOT NULL").withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("want_rule").alias("rule"), F.col("technique").alias("rule_technique"))
    j = cases.join(captures.withColumn("captured", F.lit(True)), "case_id", "left").join(records, "case_id", "left")
    inside = F.col("want_rule").isNull() | in_window(F.col("time"), F.col("trigger"), F.col("seconds"))
    j = j.withColumn("rules", F.when(inside, F.col("rules"))).withColumn("seen_class", F.when(inside, F.col("class_uid")))
    hit = (F.col("seen_class") == F.col("want_class")) & F.array_contains("rules", F.col("want_rule"))
    base = ["case_id", "tier", "technique", "expected_result", "want_rule"]
    v = j.groupBy(*base).agg(
        F.bool_or(F.coalesce("captured", F.lit(False))).alias("captured"),
        F.bool_or(F.coalesce(hit, F.lit(False))).alias("hit"),
        F.bool_or(F.coalesce(F.col("seen_class") == F.col("want_class"), F.lit(False))).alias("class_seen"),
        F.min(F.when(hit, F.greatest(F.col("time") - F.col("trigger"), F.lit(0)))).alias("latency_ms"),
    )
    others = j.select(*base, F.explode("rules").alias("rule")).where("want_rule IS NULL OR rule <> want_rule").join(techniques, "rule")
    others = others.where(~F.arrays_overlap(F.split("technique", r"\+"), F.split("rule_technique", r"\+")))
    cross = others.groupBy("case_id").agg(F.array_sort(F.collect_set("rule")).alias("fp_rules"))
    gap = F.when(F.col("hit"), "GAP_CLOSED").otherwise("GAP")
    verdict = F.when(~F.col("captured"), "NO_DATA").when(F.col("want_rule").isNull(), "GAP").when(F.col("expected_result") == "miss", gap).when(F.col("hit"), "HIT").when(F.col("class_seen"), "PARTIAL").otherwise("MISS")
    return v.join(cross, "case_id", "left").select("case_id", "tier", "technique", verdict.alias("verdict"), "latency_ms", F.coalesce("fp_rules", F.array().cast("array<string>")).alias("fp_rules"))


def peer_verdicts(cases: DataFrame, captures: DataFrame, alerts: DataFrame) -> DataFrame:
    """As score_cases, for another agent's alerts (case_id, time, techniques, label): a hit is an overlap of techniques. The
    labels of alerts in the window for other techniques alone are `fp_rules`, cross-technique and for information."""
    j = cases.join(captures.withColumn("captured", F.lit(True)), "case_id", "left").join(alerts, "case_id", "left")
    inside = F.coalesce("captured", F.lit(False)) & (F.col("want_rule").isNull() | in_window(F.col("time"), F.col("trigger"), F.col("seconds")))
    hit = inside & F.arrays_overlap(F.split("technique", r"\+"), F.col("techniques"))
    other = inside & ~hit & (F.size("techniques") > 0)
    v = j.groupBy("case_id", "tier", "technique", "expected_result").agg(
        F.bool_or(F.coalesce("captured", F.lit(False))).alias("captured"), F.bool_or(F.coalesce(hit, F.lit(False))).alias("hit"), F.array_sort(F.collect_set(F.when(other, F.col("label")))).alias("fp_rules")
    )
    verdict = F.when(~F.col("captured"), "NO_DATA").when(F.col("expected_result") == "miss", F.when(F.col("hit"), "GAP_CLOSED").otherwise("GAP")).when(F.col("hit"), "HIT").otherwise("MISS")
    return v.select("case_id", "tier", "technique", verdict.alias("verdict"), "fp_rules")


def coverage(verdicts: DataFrame) -> DataFrame:
    """Hits among tier A, in percent to one decimal, gaps that closed, and cross-technique hits."""
    a = F.col("tier") == "A"
    g = verdicts.agg(F.count_if(a).alias("total"), F.count_if(a & (F.col("verdict") == "HIT")).alias("hits"), F.count_if(F.col("verdict") == "GAP_CLOSED").alias("gaps_closed"), F.coalesce(F.sum(F.size("fp_rules")), F.lit(0)).alias("cross_technique"))
    return g.withColumn("coverage_pct", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(F.round(1000.0 * F.col("hits") / F.col("total")) / 10.0))


def latency_by_class(cases: DataFrame, captures: DataFrame, records: DataFrame) -> DataFrame:
    """Count, median and 95th percentile of first-hit latencies by class, not limited to the window. The median of an
    even count is the whole-number mean of the middle two; the percentile is the value at round(0.95 (n - 1))."""
    j = cases.where("want_rule IS NOT NULL").join(captures, "case_id").join(records, "case_id").where("class_uid = want_class").where(F.array_contains("rules", F.col("want_rule")) & F.col("time").isNotNull())
    one = j.groupBy("case_id", "want_class").agg(F.min(F.greatest(F.col("time") - F.col("trigger"), F.lit(0))).alias("ms"))
    counts = one.groupBy(F.col("want_class").alias("class_uid"), "ms").agg(F.count("*").alias("cases"))
    counts = cut(counts)
    n = counts.groupBy("class_uid").agg(F.sum("cases").alias("n"))
    ranks = F.create_map(F.lit("lower"), F.expr("(n - 1) div 2"), F.lit("upper"), F.expr("n div 2"), F.lit("p95"), F.round(F.lit(0.95) * (F.col("n") - 1)).cast("long"))
    at = values_at(counts, n.select("class_uid", F.explode(ranks).alias("which", "rank")))
    pick = lambda which: F.max(F.when(F.col("which") == which, F.col("ms")))
    g = at.groupBy("class_uid").agg(*[pick(w).alias(w) for w in ("lower", "upper", "p95")]).join(n, "class_uid")
    return g.select("class_uid", F.col("n").cast("int").alias("n"), F.expr("lower + (upper - lower) div 2").alias("median_ms"), F.col("p95").alias("p95_ms"))


def values_at(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class_uid, which, ms): the value at each rank, from 0, of `wanted` (class_uid, which, rank; a few rows a class).

    `counts`: class_uid, ms (not negative), cases. The value is found by 16 bits a round, from the upper ones on: values
    that agree with it so far are counted by their next bits, so a running sum is over 65,536 rows at most.
    """
    found = wanted.withColumn("known", F.lit(0).cast("long"))
    for shift in (48, 32, 16, 0):
        known = F.lit(0).cast("long") if shift == 48 else F.shiftright("ms", shift + 16)
        at = counts.select("class_uid", known.alias("known"), F.shiftright("ms", shift).alias("next"), "cases")
        at = at.join(F.broadcast(found), ["class_uid", "known"]).groupBy("class_uid", "which", "rank", "next").agg(F.sum("cases").alias("cases"))
        upto = F.sum("cases").over(Window.partitionBy("class_uid", "which").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        at = at.withColumn("before", upto - F.col("cases")).where(F.col("rank").between(F.col("before"), F.col("before") + F.col("cases") - 1))
        found = at.select("class_uid", "which", (F.col("rank") - F.col("before")).alias("rank"), F.col("next").alias("known"))
    return found.select("class_uid", "which", F.col("known").alias("ms"))


def violations(envelope: DataFrame) -> DataFrame:
    """Adds `violations`: which fields are missing or out of range."""
    need = ["class_uid", "class_name", "time", "severity_id", "metadata", "device", "data"]
    missing = [F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in need]
    known = F.when(F.col("class_uid").isNotNull() & ~F.col("class_uid").isin(list(CLASSES)), F.lit("unknown_class"))
    level = F.when(F.col("severity_id").isNotNull() & ~F.col("severity_id").between(1, 6), F.lit("severity_out_of_range"))
    return envelope.withColumn("violations", F.array_compact(F.array(*missing, known, level)))


def conformance(checked: DataFrame) -> DataFrame:
    g = checked.groupBy("class_uid").agg(F.count("*").alias("total"), F.count_if(F.size("violations") == 0).alias("passed"))
    return g.withColumn("pct", F.round(1000.0 * F.col("passed") / F.col("total")) / 10.0)


def top_violations(checked: DataFrame, n: int = 10) -> DataFrame:
    v = checked.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("records"))
    return v.orderBy(F.desc("records"), "violation").limit(n)


def idle_false_positives(baseline: DataFrame, peer: bool = False) -> DataFrame:
    """Baseline records (`rules`) with a rule, and the distinct rules. Of another agent (`peer`) every alert counts, whether or
    not its rule has a name: it was raised while nothing happened."""
    fired = F.count("*") if peer else F.count_if(F.size("rules") > 0)
    return baseline.agg(fired.alias("false_positives"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("rules")))).alias("rules"))


def case_matrix(verdicts: DataFrame) -> DataFrame:
    """Cases by technique and verdict, with the rules of other techniques that fired."""
    fp = F.array_sort(F.array_distinct(F.flatten(F.collect_set("fp_rules"))))
    return verdicts.groupBy("technique", "tier", "verdict").agg(F.count("*").alias("cases"), F.min("latency_ms").alias("fastest_ms"), fp.alias("fp_rules"))


#: How to read other agents' raw alerts, by agent: the techniques (a JSON array), the rule's name, and the shape of the ids
#: among other tags, where they are mixed with such. More are added here.
PEERS = {"wazuh": ("$.rule.mitre.id", "$.rule.id", None), "falco": ("$.tags", "$.rule", r"\AT[0-9]+(\.[0-9]+)*\z")}


def _text(value: Column, path: str = "$") -> Column:
    """A string of a parsed value; null for what isn't a JSON string."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def _of_peer(agent: Column, of) -> Column:
    out = F.lit(None)
    for name, paths in PEERS.items():
        out = F.when(agent == name, of(*paths)).otherwise(out)
    return out


def peer_label(agent: Column, alert: Column) -> Column:
    """Name of a raw alert's rule: agent and rule id, or a question mark where this is no string; null for an agent that
    isn't known."""
    parsed = F.try_parse_json(alert)
    return _of_peer(agent, lambda _, rule, __: F.concat(agent, F.lit(":"), F.coalesce(_text(parsed, rule), F.lit("?"))))


def peer_techniques(agent: Column, alert: Column) -> Column:
    """Techniques of a raw alert, of mixed tags by the shape of their ids; none for an agent that isn't known."""
    parsed, none = F.try_parse_json(alert), F.array().cast("array<string>")

    def of(techniques: str, _, shape: str | None) -> Column:
        found = F.array_compact(F.transform(F.coalesce(F.try_variant_get(parsed, techniques, "array<variant>"), F.array().cast("array<variant>")), lambda x: _text(x)))
        return F.filter(found, lambda t: t.rlike(shape)) if shape else found

    return F.coalesce(_of_peer(agent, of), none)
