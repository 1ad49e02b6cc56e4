"""Posture over snapshot tables: controls, drift, file integrity, and change gates.

Snapshots are rows (asset_id, table, row_no, fields map<string,string>): the current state of a host, in order. A host
that doesn't have a table is skipped by whatever looks at that table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.operators.findings import weighted_findings
from emberwatch.sources.shared import if_few, settings


@dataclass(frozen=True)
class Control:
    """A named check of one table: a boolean aggregate over its rows."""

    control_id: str
    table: str
    subject: str
    location: str
    weight: float
    remediation_key: str
    check: Callable[[], Column]


def _value(name: str) -> Column:
    return F.element_at("fields", name)


def root_login_disabled() -> Column:
    return F.bool_or(F.coalesce((_value("key") == "PermitRootLogin") & (_value("value") == "no"), F.lit(False)))


def telnet_absent() -> Column:
    return ~F.bool_or(F.coalesce(_value("name") == "telnet", F.lit(False)))


def password_age() -> Column:
    first = F.min_by(_value("value"), F.when(_value("key") == "PASS_MAX_DAYS", F.col("row_no")))
    days = F.when(F.count_if(_value("key") == "PASS_MAX_DAYS") > 0, F.when(first.rlike(r"\A[+-]?[0-9]+\z"), first.try_cast("long")))
    return F.coalesce(days <= 365, F.lit(False))


CONTROLS = [
    Control("sshd-root-login-disabled", "sshd_config", "sshd_config", "/etc/ssh/sshd_config", 0.8, "set:PermitRootLogin=no", root_login_disabled),
    Control("telnet-not-installed", "packages", "telnet", "package-manager", 0.6, "remove:telnet", telnet_absent),
    Control("password-max-days", "login_defs", "login.defs", "/etc/login.defs", 0.5, "set:PASS_MAX_DAYS<=365", password_age),
]


def apply_overrides(controls: list[Control], overrides: list[tuple[str, bool | None, float | None]]) -> list[Control]:
    """Policy of (control id, enabled, weight): the first one for an id counts; disabled ones go; unknown ids don't matter."""
    first = {}
    for o in overrides:
        first.setdefault(o[0], o)
    out = []
    for c in controls:
        _, enabled, weight = first.get(c.control_id, (None, None, None))
        if enabled is not False:
            out.append(c if weight is None else Control(c.control_id, c.table, c.subject, c.location, weight, c.remediation_key, c.check))
    return out


def evaluate_controls(snapshots: DataFrame, controls: list[Control] = CONTROLS) -> DataFrame:
    """A row for each host and control whose table the host has. One aggregation per control, over its table only."""
    parts = []
    for c in controls:
        g = snapshots.where(F.col("table") == c.table).groupBy("asset_id").agg(c.check().alias("passed"))
        parts.append(g.select("asset_id", F.lit(c.control_id).alias("control_id"), "passed", F.lit(c.weight).cast("float").alias("weight"), F.lit(c.subject).alias("subject"), F.lit(c.location).alias("location"), F.lit(c.remediation_key).alias("remediation_key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_frameworks(results: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Adds `frameworks`, array of (framework, control_ids), from (control_id, framework, framework_control)."""
    inner = crosswalk.groupBy("control_id", "framework").agg(F.array_sort(F.collect_set("framework_control")).alias("control_ids"))
    outer = inner.groupBy("control_id").agg(F.array_sort(F.collect_list(F.struct("framework", "control_ids"))).alias("frameworks"))
    return results.join(if_few(outer), "control_id", "left")  # a row a control


def first_match(snapshots: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries with the first row of each host that their selector finds, null where there is none; hosts without the
    entry's table are left out. `entries` are broadcast where they are few."""
    has = snapshots.select("asset_id", "table").distinct().join(if_few(entries), "table")
    e = entries.select("entry_id", "table", "selector_field", "selector_value")
    hit = snapshots.join(if_few(e), "table").where(F.element_at("fields", F.col("selector_field")) == F.col("selector_value"))
    one = hit.groupBy("asset_id", "entry_id").agg(F.min_by("fields", "row_no").alias("row"))
    return has.join(one, ["asset_id", "entry_id"], "left")


def drift(snapshots: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline entries against hosts: a value that differs or is missing, or a row that must be absent.

    `baseline`: entry_id, table, selector_field, selector_value, value_field (null: must be absent), expected, subject,
    location, weight, remediation_key."""
    m = first_match(snapshots, baseline)
    absent = F.col("value_field").isNull()
    actual = F.when(absent, F.when(F.col("row").isNotNull(), "present")).otherwise(F.element_at("row", F.col("value_field")))
    drifted = F.when(absent, F.col("row").isNotNull()).otherwise(~actual.eqNullSafe(F.col("expected")))
    return m.select("asset_id", "entry_id", drifted.alias("drifted"), "subject", "location", F.col("weight").cast("float").alias("weight"), F.when(absent, "absent").otherwise(F.col("expected")).alias("expected"), actual.alias("actual"), "remediation_key")


def integrity(files: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Watched paths against file rows (asset_id, row_no, path, sha256, exists): a missing path or a file that is gone
    shows as `<deleted>`; else the digests must be equal. `watchlist`: entry_id, path, expected_sha256, weight,
    remediation_key. A file row without `exists` is present. The result has a row for each host and entry, so a watchlist is a list of settings: one that is too long fails."""
    hosts = files.select("asset_id").distinct()
    first = files.groupBy("asset_id", "path").agg(F.min_by(F.struct("sha256", "exists"), "row_no").alias("row"))
    m = hosts.join(settings(watchlist, "the watchlist"), F.col("path").isNotNull()).join(first, ["asset_id", "path"], "left")
    here = F.col("row").isNotNull() & F.coalesce(F.col("row.exists"), F.lit(True))
    actual = F.when(here, F.col("row.sha256")).otherwise("<deleted>")
    return m.select("asset_id", "entry_id", "path", (~actual.eqNullSafe(F.col("expected_sha256"))).alias("violated"), F.col("weight").cast("float").alias("weight"), "expected_sha256", actual.alias("actual_sha256"), "remediation_key")


def health(samples: DataFrame, used: Column, budget: Column) -> DataFrame:
    """Adds `used_pct` of a budget and `over_budget`; a budget of nothing shows as the greatest single-precision number."""
    pct = F.when(budget <= 0, F.lit(3.4028234663852886e38).cast("float")).otherwise((used / budget * 100).cast("float"))
    return samples.withColumn("used_pct", pct).withColumn("over_budget", F.col("used_pct") > 100)


def host_inventory(os: DataFrame, packages: DataFrame) -> DataFrame:
    """(asset_id, os, packages, package_count): a host's system rows and its packages, each as a sorted array. Hosts
    without packages have none."""
    row = lambda d: F.struct(*[F.col(c) for c in d.columns if c != "asset_id"])
    a = os.groupBy("asset_id").agg(F.array_sort(F.collect_list(row(os))).alias("os"))
    b = packages.groupBy("asset_id").agg(F.array_sort(F.collect_list(row(packages))).alias("packages"), F.count("*").alias("package_count"))
    j = a.join(b, "asset_id", "full_outer")
    return j.withColumn("package_count", F.coalesce("package_count", F.lit(0).cast("long")))


def network_inventory(hosts: DataFrame, swept: DataFrame) -> DataFrame:
    """(asset_id, role, swept_cidrs, host_count, hosts) of scanners that found a host; of others nothing. `hosts`: asset_id,
    addr; `swept`: asset_id, cidr."""
    h = hosts.groupBy("asset_id").agg(F.array_sort(F.collect_set("addr")).alias("hosts"))
    s = swept.groupBy("asset_id").agg(F.array_sort(F.collect_set("cidr")).alias("swept_cidrs"))
    return h.join(s, "asset_id", "left").select("asset_id", F.lit("network-scanner").alias("role"), "swept_cidrs", F.size("hosts").cast("long").alias("host_count"), "hosts")


def change_gate(snapshots: DataFrame, keys: list[str], order: list[str], payload: str) -> DataFrame:
    """Rows whose payload differs from the previous one of its key; the first always stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    h = F.xxhash64(F.col(payload))
    return snapshots.withColumns({"_h": h, "_p": F.lag(h).over(w), "_n": F.row_number().over(w)}).where("_n = 1 OR _h <> _p").drop("_h", "_p", "_n")


def first_sightings(loads: DataFrame) -> DataFrame:
    """First row of each library path of a host."""
    rest = [c for c in loads.columns if c not in ("asset_id", "path")]
    one = loads.groupBy("asset_id", "path").agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("first"))
    return one.select("asset_id", "path", "first.*").select(*loads.columns)


def compliance_findings(results: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    r = results.where("NOT passed").select("asset_id", F.col("control_id").alias("vuln_id"), F.col("subject").alias("component"), "location", "weight", "remediation_key")
    return weighted_findings(r, assets)


def drift_findings(results: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    r = results.where("drifted").select("asset_id", F.col("entry_id").alias("vuln_id"), F.col("subject").alias("component"), "location", "weight", "remediation_key")
    return weighted_findings(r, assets)


def integrity_findings(results: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    r = results.where("violated").select("asset_id", F.col("entry_id").alias("vuln_id"), F.col("path").alias("component"), F.lit("filesystem").alias("location"), "weight", "remediation_key")
    return weighted_findings(r, assets)
