"""Software inventories against advisories, enrichment, reachability, and scored findings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions import scoring as S
from emberwatch.functions.rules import let
from emberwatch.functions.versions import key_for, semver_key
from emberwatch.operators.findings import IDENTITY, correlate, fix_queue, reconcile, with_context
from emberwatch.operators.intervals import FEW, containing, stabbed
from emberwatch.sources.shared import cut, if_few, spread

# Fixed values.
RPM_BASES = ["Red Hat", "Rocky Linux", "AlmaLinux", "CentOS", "Oracle Linux", "SUSE", "openSUSE", "Mageia"]
ARCHITECTURE_NOTES = ["(64-bit x64)", "(32-bit x86)", "(64-bit)", "(32-bit)", "(x64)", "(x86)", "(64 bit)", "(32 bit)"]
EVENTS = "array<struct<introduced:string,fixed:string,last_affected:string>>"
OSV = f"id string, ecosystem string, name string, versions array<string>, ranges array<struct<type:string,events:{EVENTS}>>"
NVD = f"id string, product string, aliases array<string>, ranges {EVENTS}"
HITS = ["name", "version", "source", "os", "vuln_id", "remediation_key"]


def family(ecosystem: Column) -> Column:
    base = F.trim(F.split_part(ecosystem, F.lit(":"), F.lit(1)))
    return F.when(base == "Debian", "debian").when(base == "Ubuntu", "ubuntu").when(base.isin(RPM_BASES), "rpm").otherwise("other")


def families_of(source: Column, os: Column) -> Column:
    """Which advisories a component is held against: dpkg by the host's system, both families if that is unknown."""
    low = F.lower(F.coalesce(os, F.lit("")))
    dpkg = F.when(low.contains("ubuntu"), F.array(F.lit("ubuntu"))).when(low.contains("debian"), F.array(F.lit("debian"))).otherwise(F.array(F.lit("ubuntu"), F.lit("debian")))
    return F.when(source == "dpkg", dpkg).when(source == "rpm", F.array(F.lit("rpm"))).otherwise(F.array().cast("array<string>"))


def distinct_components(sbom: DataFrame) -> DataFrame:
    """A fleet has few distinct (name, version, source, os); matching works on these, and hosts are joined at the end."""
    return sbom.select("name", "version", "source", "os").distinct()


def exact_hits(components: DataFrame, feed: DataFrame) -> DataFrame:
    """Equal name and version. `feed`: name, version, vuln_id, remediation_key."""
    return components.join(feed, ["name", "version"]).select(*HITS).dropDuplicates(["name", "version", "source", "os", "vuln_id"])


def first_fixed(ranges: Column) -> Column:
    """The first fixed version over all ranges, also those that don't match."""
    return F.get(F.filter(F.flatten(F.transform(ranges, lambda r: F.transform(r["events"], lambda e: e["fixed"]))), lambda f: f.isNotNull()), 0)


def _walk(events: Column, key: Column) -> Column:
    """Events in order switch `affected`: introduced on, fixed off, beyond last_affected off; what can't be compared
    with a bound counts as fixed."""

    def step(on: Column, e: Column) -> Column:
        on = F.when((e["introduced"] == "0") | (key >= e["ik"]), True).otherwise(on)
        on = F.when(e["fixed"].isNotNull() & F.coalesce(key >= e["fk"], F.lit(True)), False).otherwise(on)
        return F.when(e["last_affected"].isNotNull() & F.coalesce(key > e["lk"], F.lit(True)), False).otherwise(on)

    return F.aggregate(events, F.lit(False), step)


def with_keys(bound: Column, key: Callable[[Column], Column]) -> Column:
    """The three bounds as a struct with their keys; `key` stands in the plan once."""
    names = ("introduced", "fixed", "last_affected")
    own = [bound[c].alias(c) for c in names]
    return let(F.transform(F.array(*[bound[c] for c in names]), key), lambda k: F.struct(*own, *[k[i].alias(c) for i, c in enumerate(("ik", "fk", "lk"))]))


def keyed_ranges(advisories: DataFrame) -> DataFrame:
    """(family, name, vuln_id, listed, keyed, remediation_key) of advisories with a family: `keyed` has the ranges that are
    compared, with the kind of their versions, and their events with a key for each bound."""
    a = advisories.withColumn("family", family(F.col("ecosystem"))).where("family <> 'other'")
    kind = lambda r: F.when(r["type"] == "SEMVER", "semver").when((r["type"] == "ECOSYSTEM"), F.when(F.col("family") == "rpm", "rpm").otherwise("dpkg"))
    keyed = F.transform(
        F.filter("ranges", lambda r: r["type"].isin("SEMVER", "ECOSYSTEM")),
        lambda r: F.struct(kind(r).alias("kind"), F.transform(r["events"], lambda e: with_keys(e, lambda v: key_for(kind(r), v))).alias("events")),
    )
    fix = F.coalesce(F.concat(F.lit("upgrade:"), F.col("name"), F.lit(">="), first_fixed(F.col("ranges"))), F.concat(F.lit("patch:"), F.col("name"), F.lit(":"), F.col("id")))
    return a.select("family", "name", F.col("id").alias("vuln_id"), F.coalesce("versions", F.array().cast("array<string>")).alias("listed"), keyed.alias("keyed"), fix.alias("remediation_key"))


def _first_fix(hits: DataFrame) -> DataFrame:
    """One hit per component and vulnerability; of several fixes the least, whatever the order of rows."""
    return hits.groupBy("name", "version", "source", "os", "vuln_id").agg(F.min("remediation_key").alias("remediation_key")).select(*HITS)


def osv_hits(components: DataFrame, advisories: DataFrame, few: int = FEW) -> DataFrame:
    """Range join by family and name; one hit per component and advisory. Keys of bounds are made once per advisory and
    keys of versions once per distinct version. Versions and ranges meet by equality (see intervals), so a package with very
    many advisories and versions costs what it hits, not their product; `few` ranges or fewer are broadcast. Listed
    versions are an equi-join. Advisories are spread first, as keys and ranges are much work a row; components, which both
    the versions and the hits are made from, are worked out once."""
    a = cut(keyed_ranges(spread(advisories)))
    c = cut(components).withColumn("family", F.explode(families_of(F.col("source"), F.col("os"))))
    native = F.when(F.col("family") == "rpm", "rpm").otherwise("dpkg")
    kinds = F.array(F.struct(native.alias("kind"), key_for(native, F.col("version")).alias("key")), F.struct(F.lit("semver").alias("kind"), semver_key(F.col("version")).alias("key")))
    versions = cut(c.select("family", "name", "version").distinct().withColumn("v", F.explode(kinds)).select("family", "name", "version", "v.kind", "v.key"))
    ranges = a.select("family", "name", "vuln_id", "remediation_key", F.explode("keyed").alias("r")).select("family", "name", "r.kind", "vuln_id", "remediation_key", "r.events")
    bounds = F.flatten(F.transform("events", lambda e: F.array(e["ik"], e["fk"], e["lk"])))
    found = stabbed(versions, ranges, ["family", "name", "kind"], bounds, lambda key: _walk(F.col("events"), key), ["vuln_id", "remediation_key"], few)
    inside = _by_key(versions, found)
    listed = a.select("family", "name", "vuln_id", "remediation_key", F.explode("listed").alias("version"))
    cols = ["family", "name", "version", "vuln_id", "remediation_key"]
    hit = inside.select(*cols).unionByName(listed.join(versions.select("family", "name", "version").distinct(), ["family", "name", "version"], "left_semi").select(*cols)).distinct()
    return _first_fix(c.join(hit, ["family", "name", "version"]))


def _by_key(versions: DataFrame, found: DataFrame) -> DataFrame:
    """Versions with what was found for their key, null keys among each other."""
    on = [F.coalesce("key", F.lit("")).alias("_key"), F.col("key").isNull().alias("_none")]
    return versions.select("*", *on).join(found.select(*[c for c in found.columns if c != "key"], *on), ["family", "name", "kind", "_key", "_none"])


def display_name(name: Column) -> Column:
    out = F.lower(name)
    for note in ARCHITECTURE_NOTES:
        out = F.replace(out, F.lit(note), F.lit(" "))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def nvd_hits(components: DataFrame, advisories: DataFrame, few: int = FEW) -> DataFrame:
    """Installed products (source `registry`) whose name contains an alias, in a range that has a bound. Distinct names
    meet the aliases that wait under a fragment of theirs, versions their ranges by equality (see intervals). Advisories are
    spread first, and components worked out once, as in osv_hits()."""
    a = cut(spread(advisories).select("id", "product", F.transform("aliases", F.lower).alias("aliases"), F.coalesce("ranges", F.array().cast(EVENTS)).alias("ranges")).withColumn("entry", F.monotonically_increasing_id()))
    mine = cut(components.where("source = 'registry'"))
    names = cut(mine.select("name").distinct().withColumn("shown", display_name(F.col("name"))))
    waits = a.select("entry", F.explode("aliases").alias("needle"))
    met = containing(names.select(F.col("shown").alias("text")), waits.select("needle"))
    named = names.join(met, F.col("shown") == F.col("text")).join(waits, "needle").select("name", "entry").distinct()
    fixed = F.get(F.filter(F.transform("ranges", lambda r: r["fixed"]), lambda f: f.isNotNull()), 0)
    fix = F.coalesce(F.concat(F.lit("upgrade:"), F.col("product"), F.lit(">="), fixed), F.concat(F.lit("patch:"), F.col("product"), F.lit(":"), F.col("id")))
    keyed = F.transform("ranges", lambda r: with_keys(r, semver_key))
    ranges = named.join(a.select("entry", F.col("id").alias("vuln_id"), fix.alias("remediation_key"), keyed.alias("keyed")), "entry").select("name", "vuln_id", "remediation_key", F.explode("keyed").alias("r"))

    def inside(key: Column) -> Column:
        r = F.col("r")
        bounded = r["introduced"].isNotNull() | r["fixed"].isNotNull() | r["last_affected"].isNotNull()
        low = r["introduced"].isNull() | F.coalesce(key >= r["ik"], F.lit(False))
        high = r["fixed"].isNull() | F.coalesce(key < r["fk"], F.lit(False))
        last = r["last_affected"].isNull() | F.coalesce(key <= r["lk"], F.lit(False))
        return bounded & low & high & last

    versions = mine.withColumn("key", semver_key(F.col("version"))).where("key IS NOT NULL")  # others are in no range
    found = stabbed(versions.select("name", "key"), ranges, ["name"], F.array("r.ik", "r.fk", "r.lk"), inside, ["vuln_id", "remediation_key"], few).distinct()
    return _first_fix(versions.join(found, ["name", "key"]))


def composite_hits(*sources: DataFrame) -> DataFrame:
    """Hits of several sources; of equal (component, vulnerability) the earliest source's one."""
    ranked = [h.withColumn("rank", F.lit(k)) for k, h in enumerate(sources)]
    both = ranked[0]
    for h in ranked[1:]:
        both = both.unionByName(h)
    return both.groupBy("name", "version", "source", "os", "vuln_id").agg(F.min_by("remediation_key", "rank").alias("remediation_key")).select(*HITS)


def enrichment(cvss: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """By vulnerability: cvss_env and maturity (and the vector, if the evidence has it), epss (and its percentile), kev. A known exploited one counts as weaponized at least; any
    evidence means affected."""
    j = cvss.join(epss, "vuln_id", "full_outer").join(kev.select("vuln_id").distinct().withColumn("kev", F.lit(True)), "vuln_id", "full_outer")
    listed = F.coalesce("kev", F.lit(False))
    more = [c for c in ("vector", "percentile") if c in j.columns]
    return j.select("vuln_id", F.col("cvss_env").cast("float").alias("cvss_env"), F.col("epss").cast("float").alias("epss"), *more, listed.alias("kev"), F.when(listed, "weaponized").otherwise(F.coalesce("maturity", F.lit("none"))).alias("maturity"), F.lit("affected").alias("vex"))


def reachability(libraries: DataFrame, loads: DataFrame) -> DataFrame:
    """(asset_id, component) with a library of the package seen loaded, and the assets that have load data at all.
    `libraries`: asset_id, component, path; `loads`: asset_id, path. Loads are reduced to distinct paths first."""
    seen = loads.select("asset_id", "path").distinct()
    hit = libraries.join(seen, ["asset_id", "path"], "left_semi").select("asset_id", "component").distinct().withColumn("hit", F.lit(True))
    has = seen.select("asset_id").distinct()
    return libraries.select("asset_id", "component").distinct().join(has, "asset_id", "left_semi").join(hit, ["asset_id", "component"], "left").select("asset_id", "component", F.coalesce("hit", F.lit(False)).alias("runtime_reachable"))


def vulnerability_run(sbom: DataFrame, hits: DataFrame, enriched: DataFrame, prior: DataFrame, now: Column, assets: DataFrame | None = None, runtime: DataFrame | None = None, closes: bool = False) -> tuple[DataFrame, DataFrame]:
    """(findings, queue of fixes) of inventories: matched, correlated, scored, compared with the prior state, and counted
    by fix without what is suppressed. `closes`: see fix_queue()."""
    found = vulnerability_findings(detections(sbom, hits), enriched, assets, runtime)
    found = reconcile(prior, found.withColumns({c: F.lit(None).cast("long") for c in ("first_seen", "last_seen", "closed_at")}), now)
    return found, fix_queue(found, closes)


def detections(sbom: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of each host's components: authenticated, of confidence 0.95. What a finding is about is the package of a source,
    not its version: `versions` tells which installed ones are hit, so an upgrade that doesn't help is the same finding. Of
    several fixes the least counts. One group has the versions of one package on one host. Where hits of distinct components
    are few they go to the inventories, which are not shuffled for it."""
    j = sbom.join(if_few(cut(hits)), ["name", "version", "source", "os"])
    g = j.groupBy("asset_id", "vuln_id", F.col("name").alias("component"), F.col("source").alias("location")).agg(F.min("remediation_key").alias("remediation_key"), F.array_sort(F.collect_set("version")).alias("versions"))
    return g.select(*IDENTITY, F.lit("sbom").alias("source"), F.lit("authenticated").alias("method"), F.lit(0.95).cast("float").alias("confidence"), "remediation_key", F.col("remediation_key").alias("seq"), "versions")


def vulnerability_findings(found: DataFrame, enriched: DataFrame, assets: DataFrame | None = None, runtime: DataFrame | None = None) -> DataFrame:
    """Scored findings of deduplicated detections. Unknown vulnerabilities have no evidence and an unknown reach."""
    one = correlate(found)
    j = with_context(one.join(enriched, "vuln_id", "left"), assets)
    j = j.withColumns({"vex": F.coalesce("vex", F.lit("unknown")), "kev": F.coalesce("kev", F.lit(False)), "maturity": F.coalesce("maturity", F.lit("none"))})
    j = j.join(runtime, ["asset_id", "component"], "left") if runtime is not None else j.withColumn("runtime_reachable", F.lit(None).cast("boolean"))
    reach = S.upgraded_reach(F.col("vex"), F.col("runtime_reachable"))
    j = j.withColumn("explain", S.vulnerability_explain(F.col("cvss_env"), F.col("epss"), F.col("maturity"), F.col("vex"), F.col("internet_facing"), F.col("compensating_controls"), F.col("criticality"), reach))
    j = j.withColumn("risk", S.vulnerability_risk(F.col("explain")))
    made = S.decision(F.col("risk"), F.col("kev"), F.lit(True), F.col("explain.reach"))
    return j.select(S.finding_id(*[F.col(c) for c in IDENTITY]).alias("finding_id"), *IDENTITY, "provenance", *[c for c in ("versions",) if c in j.columns], "cvss_env", "epss", "kev", "risk", "explain", "runtime_reachable", made.alias("decision"), S.sla_hours(made).alias("sla_hours"), S.initial_status(F.col("vex")).alias("status"), "remediation_key")
