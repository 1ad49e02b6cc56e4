"""Queries over software inventories: matching, enrichment, findings, and the reports on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.fixtures import PACKAGES, SBOM, _pick, _sql, sbom_components, table
from emberwatch.operators import findings as O
from emberwatch.operators import vulnerabilities as V
from emberwatch.sources.shared import cut

_e = lambda i=None, f=None, l=None: (i, f, l)  # noqa: E731, E741
ADVISORIES = [
    ("OSV-1", "Ubuntu:22.04:LTS", "openssl", [], [("ECOSYSTEM", [_e("0"), _e(None, "3.5.10")])]),
    ("OSV-2", "Debian:12", "openssl", [], [("ECOSYSTEM", [_e("3.2.0"), _e(None, None, "3.7.20")])]),
    ("OSV-3", "Red Hat:8", "curl", [], [("ECOSYSTEM", [_e("3.1.0"), _e(None, "3.4.0"), _e("3.6.0")])]),
    ("OSV-4", "Rocky Linux:9", "glibc", ["3.1.1", "3.2.12"], []),
    ("OSV-5", "Debian:12", "zlib", [], [("GIT", [_e("0")])]),
    ("OSV-6", "Ubuntu:20.04", "zlib", [], [("SEMVER", [_e("0"), _e(None, "3.3.0")])]),
]
PRODUCTS = [("CVE-W1", "sudo-win", ["sudo"], [_e("3.1.0", "3.5.0")]), ("CVE-W2", "PuTTY", ["putty"], [_e(None, None, "3.3.0")]), ("CVE-W3", "PuTTY", ["putty"], [_e()])]
FEED = [("glibc", "3.1.1", "FEED-1", "patch:glibc:FEED-1"), ("glibc", "3.2.12", "OSV-4", "patch:glibc:OSV-4"), ("curl", "3.6.6", "FEED-2", "upgrade:curl>=3.7.0")]
CVSS = [("OSV-1", 7.5, "poc"), ("OSV-2", 9.8, "none"), ("OSV-3", 5.3, "functional"), ("CVE-W1", 8.1, "none"), ("FEED-1", 3.1, "none")]
EPSS = [("OSV-1", 0.91), ("OSV-3", 0.05), ("CVE-W2", 0.4)]
KEV = [("OSV-2",), ("OSV-6",)]


def _hits(spark: SparkSession, c: DataFrame, *which: str) -> list[DataFrame]:
    make = {
        "osv": lambda: V.osv_hits(c, spark.createDataFrame(ADVISORIES, V.OSV)),
        "nvd": lambda: V.nvd_hits(c, spark.createDataFrame(PRODUCTS, V.NVD)),
        "feed": lambda: V.exact_hits(c, spark.createDataFrame(FEED, "name string, version string, vuln_id string, remediation_key string")),
    }
    return [make[w]() for w in which]


def part_advisories(spark: SparkSession, sf: str) -> DataFrame:
    """An advisory a part, of few packages: each package has very many, in both version orders, with ranges and lists."""
    p = table(spark, sf, "part")
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    minor = F.concat(F.lit("3."), (F.col("p_size") % 10).cast("string"), F.lit("."))
    none = F.lit(None).cast("string")
    event = lambda i=none, f=none, l=none: F.struct(i.alias("introduced"), f.alias("fixed"), l.alias("last_affected"))  # noqa: E731, E741
    first = F.struct(F.lit("ECOSYSTEM").alias("type"), F.array(event(F.concat(minor, F.lit("0"))), event(f=F.concat(minor, size))).alias("events"))
    second = F.struct(F.lit("SEMVER").alias("type"), F.array(event(F.lit("3.9.40")), event(l=F.concat(F.lit("3.9."), size))).alias("events"))
    listed = F.concat(F.lit("3."), ((F.col("p_size") + 1) % 10).cast("string"), F.lit("."), (F.col("p_size") + 1).cast("string"))
    system = F.when(k % 3 == 1, "Red Hat:9").when(F.floor(k / 6) % 2 == 0, "Ubuntu:22.04").otherwise("Debian:12")
    return p.select(
        F.concat(F.lit("PART-"), k.cast("string")).alias("id"), system.alias("ecosystem"), _pick(PACKAGES, k % 6).alias("name"), F.when(k % 7 == 0, F.array(listed)).alias("versions"),
        F.when(k % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("ranges"),
    )


def part_products(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(components, advisories): parts as installed products, and an advisory a part by the product's name, some also by its
    first two letters."""
    p = table(spark, sf, "part")
    minor = F.concat(F.lit("3."), (F.col("p_size") % 10).cast("string"), F.lit("."))
    fixed = F.concat(minor, F.col("p_size").cast("string"))
    shown = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " (64-bit)").otherwise(""))
    have = p.select(shown.alias("name"), fixed.alias("version"), F.lit("registry").alias("source"), F.lit("").alias("os")).distinct()
    aliases = F.when(F.col("p_partkey") % 11 == 0, F.array("p_name", F.substring("p_name", 1, 2))).otherwise(F.array("p_name"))
    event = F.struct(F.concat(minor, F.lit("0")).alias("introduced"), fixed.alias("fixed"), F.lit(None).cast("string").alias("last_affected"))
    known = p.select(F.concat(F.lit("WIN-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("product"), aliases.alias("aliases"), F.array(event).alias("ranges"))
    return have, known


def osv_matches(spark, sf):
    """Components of the fleet against a few advisories and one of each part: both sides grow."""
    a = spark.createDataFrame(ADVISORIES, V.OSV).unionByName(part_advisories(spark, sf))
    return V.osv_hits(V.distinct_components(sbom_components(spark, sf)), a)


def nvd_matches(spark, sf):
    """Installed products, parts among them, against a few advisories and one of each part."""
    have, known = part_products(spark, sf)
    c = V.distinct_components(sbom_components(spark, sf)).unionByName(have)
    return V.nvd_hits(c, spark.createDataFrame(PRODUCTS, V.NVD).unionByName(known))


def upgraded(sbom: DataFrame) -> DataFrame:
    """The inventory after every second host has moved all packages to the last minor version."""
    moved = F.concat(F.lit("3.9."), F.split_part("version", F.lit("."), F.lit(3)))
    even = F.split_part("asset_id", F.lit("-"), F.lit(2)).cast("long") % 2 == 0
    return sbom.withColumn("version", F.when(even, moved).otherwise(F.col("version"))).distinct()


def package_upgrades(spark, sf):
    """Findings of a second run, after upgrades: what is still hit is the same finding, first seen in the first run."""
    before = cut(sbom_components(spark, sf))
    after = cut(upgraded(before))
    every = V.distinct_components(before.unionByName(after)).distinct()
    hits, e = cut(V.composite_hits(*_hits(spark, every, "osv", "nvd", "feed"))), enriched(spark)
    state = V.vulnerability_run(before, hits, e, O.empty_state(spark), F.lit(1000))[0].select(*O.empty_state(spark).columns)
    f = V.vulnerability_run(after, hits, e, cut(state), F.lit(2000))[0]
    return f.select("finding_id", "status", "first_seen", "last_seen", F.array_join("versions", ",").alias("versions"))


def _match(*which: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = V.distinct_components(sbom_components(spark, sf))
        return V.composite_hits(*_hits(spark, c, *which)).select(*V.HITS)

    return run


def found(spark: SparkSession, sf: str) -> DataFrame:
    sbom = cut(sbom_components(spark, sf))  # matched by distinct component, then joined by host
    return V.detections(sbom, V.composite_hits(*_hits(spark, V.distinct_components(sbom), "osv", "nvd", "feed")))


def enriched(spark: SparkSession) -> DataFrame:
    return V.enrichment(spark.createDataFrame(CVSS, "vuln_id string, cvss_env float, maturity string"), spark.createDataFrame(EPSS, "vuln_id string, epss float"), spark.createDataFrame(KEV, "vuln_id string"))


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return V.vulnerability_findings(found(spark, sf), enriched(spark))


def vulnerability_findings(spark, sf):
    return findings(spark, sf).select("finding_id", "risk", "decision", "sla_hours", "status", "remediation_key")


def upgrade_queue(spark, sf):
    return O.fix_queue(findings(spark, sf).where(F.col("remediation_key").startswith("upgrade:")))


def cvss_bands(spark, sf):
    band = F.when(F.col("cvss_env") >= 9, "critical").when(F.col("cvss_env") >= 7, "high").when(F.col("cvss_env") >= 4, "medium").when(F.col("cvss_env") > 0, "low").otherwise("none")
    return findings(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("findings"), F.countDistinct("vuln_id").alias("cves"), F.count_if("kev").alias("kev"))


def top_vulnerabilities(spark, sf):
    return findings(spark, sf).groupBy("vuln_id").agg(F.max("risk").alias("risk"), F.count("*").alias("findings")).orderBy(F.desc("risk"), "vuln_id").limit(10)


def top_packages(spark, sf):
    return findings(spark, sf).groupBy("component").agg(F.count("*").alias("findings"), F.max("risk").alias("risk")).orderBy(F.desc("findings"), "component").limit(10)


def top_hosts(spark, sf):
    return findings(spark, sf).groupBy("asset_id").agg(F.count("*").alias("findings"), F.max("risk").alias("risk")).orderBy(F.desc("findings"), "asset_id").limit(10)


def by_decision(spark, sf):
    return findings(spark, sf).groupBy("decision", "status").agg(F.count("*").alias("findings"), F.countDistinct("vuln_id").alias("cves"))


def sbom_shape(spark, sf):
    s = sbom_components(spark, sf)
    return s.groupBy("asset_id").agg(F.count("*").alias("component_count"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def _rows(rows, cols: str) -> str:
    q = lambda v: "NULL" if v is None else "[" + ", ".join(map(q, v)) + "]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(q, r)) + ')' for r in rows)}) t({cols}))"


_num = lambda v: f"list_transform(string_split({v}, '.'), lambda x: CAST(x AS INT))"
#: The advisories' ranges as flat intervals [low, high) or [low, last]: enough for ascending events of numeric versions.
_FLAT = [
    ("OSV-1", "ubuntu", "openssl", "0", "3.5.10", None, "upgrade:openssl>=3.5.10"), ("OSV-2", "debian", "openssl", "3.2.0", None, "3.7.20", "patch:openssl:OSV-2"),
    ("OSV-3", "rpm", "curl", "3.1.0", "3.4.0", None, "upgrade:curl>=3.4.0"), ("OSV-3", "rpm", "curl", "3.6.0", None, None, "upgrade:curl>=3.4.0"),
    ("OSV-4", "rpm", "glibc", "3.1.1", None, "3.1.1", "patch:glibc:OSV-4"), ("OSV-4", "rpm", "glibc", "3.2.12", None, "3.2.12", "patch:glibc:OSV-4"),
    ("OSV-6", "ubuntu", "zlib", "0", "3.3.0", None, "upgrade:zlib>=3.3.0"),
    ("CVE-W1", "registry", "sudo", "3.1.0", "3.5.0", None, "upgrade:sudo-win>=3.5.0"), ("CVE-W2", "registry", "putty", "0", None, "3.3.0", "patch:PuTTY:CVE-W2"),
]


_OF_PART = f"""SELECT 'PART-' || p_partkey AS vuln_id, CASE WHEN p_partkey % 3 = 1 THEN 'rpm' WHEN (p_partkey // 6) % 2 = 0 THEN 'ubuntu' ELSE 'debian' END AS family, ({_sql(PACKAGES)})[1 + p_partkey % 6] AS name,
  r.low, r.high, r.last, 'upgrade:' || ({_sql(PACKAGES)})[1 + p_partkey % 6] || '>=3.' || (p_size % 10) || '.' || p_size AS remediation_key
  FROM part, LATERAL (SELECT '3.' || (p_size % 10) || '.0' AS low, '3.' || (p_size % 10) || '.' || p_size AS high, NULL AS last
    UNION ALL SELECT '3.9.40', NULL, '3.9.' || p_size WHERE p_partkey % 5 = 0
    UNION ALL SELECT '3.' || ((p_size + 1) % 10) || '.' || (p_size + 1), NULL, '3.' || ((p_size + 1) % 10) || '.' || (p_size + 1) WHERE p_partkey % 7 = 0) r"""
_OF_PRODUCT = f"""SELECT DISTINCT h.name, h.version, 'registry' AS source, '' AS os, 'WIN-' || w.p_partkey AS vuln_id, 'upgrade:' || w.p_brand || '>=' || w.fixed AS remediation_key
  FROM (SELECT DISTINCT p_name AS shown, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' (64-bit)' ELSE '' END AS name, p_size, '3.' || (p_size % 10) || '.' || p_size AS version FROM part) h
  JOIN (SELECT *, '3.' || (p_size % 10) || '.' || p_size AS fixed FROM part) w ON h.p_size % 10 = w.p_size % 10 AND h.p_size < w.p_size
  WHERE contains(h.shown, w.p_name) OR (w.p_partkey % 11 = 0 AND contains(h.shown, substr(w.p_name, 1, 2)))"""


def _hits_sql(where: str, feed: bool = True, more: str = "", inventory: str = "sbom", inventories: str = "") -> str:
    flat = _rows(_FLAT, "vuln_id, family, name, low, high, last, remediation_key")
    flat = f"({flat[1:-1]} UNION ALL {more})" if more else flat
    extra = f" UNION ALL SELECT name, version, source, os, f.vuln_id, f.remediation_key, 2 FROM c JOIN {_rows(FEED, 'name, version, vuln_id, remediation_key')} f USING (name, version)" if feed else ""
    return f"""{SBOM},{inventories} c AS (SELECT DISTINCT name, version, source, os FROM {inventory}),
fam AS (SELECT c.*, unnest(CASE WHEN source = 'dpkg' THEN CASE os WHEN 'Ubuntu' THEN ['ubuntu'] WHEN 'Debian' THEN ['debian'] ELSE ['ubuntu', 'debian'] END ELSE [source] END) AS family FROM c),
every AS (SELECT f.name, version, source, os, a.vuln_id, a.remediation_key, 1 AS rank FROM fam f JOIN {flat} a ON f.family = a.family AND f.name = a.name
  WHERE {_num('version')} >= {_num('low')} AND (high IS NULL OR {_num('version')} < {_num('high')}) AND (last IS NULL OR {_num('version')} <= {_num('last')}) AND {where}{extra}),
hits AS (SELECT name, version, source, os, vuln_id, min_by(remediation_key, rank) AS remediation_key FROM every GROUP BY ALL)"""


_TWO_RUNS = """ inv AS (SELECT 1 AS run, * FROM sbom UNION ALL SELECT DISTINCT 2, asset_id, name, CASE WHEN CAST(split_part(asset_id, '-', 2) AS BIGINT) % 2 = 0 THEN '3.9.' || split_part(version, '.', 3) ELSE version END, source, os FROM sbom),"""

_ENR = f"""enr AS (SELECT vuln_id, CAST(cvss AS REAL) AS cvss_env, CAST(epss AS REAL) AS epss, k.v IS NOT NULL AS kev,
  CASE WHEN k.v IS NOT NULL THEN 'weaponized' ELSE coalesce(maturity, 'none') END AS maturity
  FROM {_rows(CVSS, 'vuln_id, cvss, maturity')} c FULL JOIN {_rows(EPSS, 'vuln_id, epss')} e USING (vuln_id) FULL JOIN (SELECT vuln_id, 1 AS v FROM {_rows(KEV, 'vuln_id')}) k USING (vuln_id))"""
_R = lambda x: f"CAST({x} AS REAL)"
_FIND = f"""WITH {_hits_sql('true')}, {_ENR},
d AS (SELECT s.asset_id, h.vuln_id, s.name AS component, s.source AS location, string_agg(DISTINCT s.version, ',' ORDER BY s.version) AS versions, min(h.remediation_key) AS remediation_key FROM sbom s JOIN hits h USING (name, version, source, os) GROUP BY ALL),
x AS (SELECT d.*, e.vuln_id IS NOT NULL AS known, coalesce(kev, false) AS kev, cvss_env, least({_R(1)}, coalesce(cvss_env, {_R(0)}) / {_R(10)}) AS sev,
  greatest(coalesce(epss, {_R(0)}), {_R("CASE maturity WHEN 'poc' THEN 0.4 WHEN 'functional' THEN 0.7 WHEN 'weaponized' THEN 0.9 ELSE 0.0 END")}) AS lik FROM d LEFT JOIN enr e ON d.vuln_id = e.vuln_id),
r AS (SELECT *, CAST(round({_R(100)} * least({_R(1)}, sev * ({_R(0.4)} + {_R(0.6)} * lik) * {_R(0.8)} * {_R(0.9)} * CASE WHEN known THEN {_R(1)} ELSE {_R(0.3)} END)) AS INTEGER) AS risk FROM x),
findings AS (SELECT asset_id || '|' || vuln_id || '|' || component || '|' || location AS finding_id, asset_id, vuln_id, component, location, versions, kev, cvss_env, risk,
  CASE WHEN kev OR risk >= 70 THEN 'ACT' WHEN risk >= 40 THEN 'ATTEND' WHEN risk >= 20 THEN 'TRACK' ELSE 'DEFER' END AS decision, 'open' AS status, remediation_key FROM r)"""

QUERIES = {
    "osv_matches": osv_matches,
    "nvd_matches": nvd_matches,
    "feed_matches": _match("feed"),
    "composite_matches": _match("osv", "nvd", "feed"),
    "vulnerability_findings": vulnerability_findings,
    "upgrade_queue": upgrade_queue,
    "cvss_bands": cvss_bands,
    "top_vulnerabilities": top_vulnerabilities,
    "top_packages": top_packages,
    "top_hosts": top_hosts,
    "findings_by_decision": by_decision,
    "package_upgrades": package_upgrades,
    "sbom_shape": sbom_shape,
}
_H = ", ".join(V.HITS)
SQL = {
    "osv_matches": f"WITH {_hits_sql(chr(102) + '.family <> ' + chr(39) + 'registry' + chr(39), False, _OF_PART)} SELECT {_H} FROM hits",
    "nvd_matches": f"WITH {_hits_sql(chr(102) + '.family = ' + chr(39) + 'registry' + chr(39), False)} SELECT {_H} FROM hits UNION ALL SELECT {_H} FROM ({_OF_PRODUCT}) p",
    "feed_matches": f"WITH {_hits_sql('false')} SELECT {_H} FROM hits",
    "composite_matches": f"WITH {_hits_sql('true')} SELECT {_H} FROM hits",
    "vulnerability_findings": f"{_FIND} SELECT finding_id, risk, decision, CAST(CASE decision WHEN 'ACT' THEN 48 WHEN 'ATTEND' THEN 336 WHEN 'TRACK' THEN 720 ELSE 2160 END AS INTEGER) AS sla_hours, status, remediation_key FROM findings",
    "upgrade_queue": f"{_FIND} SELECT remediation_key, max(risk) AS risk, count(DISTINCT vuln_id) AS closes_count, count(DISTINCT asset_id) AS assets_count, count(*) AS findings, row_number() OVER (ORDER BY max(risk) DESC, remediation_key) AS queue_rank FROM findings WHERE starts_with(remediation_key, 'upgrade:') GROUP BY 1",
    "cvss_bands": f"{_FIND} SELECT CASE WHEN cvss_env >= 9 THEN 'critical' WHEN cvss_env >= 7 THEN 'high' WHEN cvss_env >= 4 THEN 'medium' WHEN cvss_env > 0 THEN 'low' ELSE 'none' END AS band, count(*) AS findings, count(DISTINCT vuln_id) AS cves, count(*) FILTER (kev) AS kev FROM findings GROUP BY 1",
    "top_vulnerabilities": f"{_FIND} SELECT vuln_id, max(risk) AS risk, count(*) AS findings FROM findings GROUP BY 1 ORDER BY risk DESC, vuln_id LIMIT 10",
    "top_packages": f"{_FIND} SELECT component, count(*) AS findings, max(risk) AS risk FROM findings GROUP BY 1 ORDER BY findings DESC, component LIMIT 10",
    "top_hosts": f"{_FIND} SELECT asset_id, count(*) AS findings, max(risk) AS risk FROM findings GROUP BY 1 ORDER BY findings DESC, asset_id LIMIT 10",
    "findings_by_decision": f"{_FIND} SELECT decision, status, count(*) AS findings, count(DISTINCT vuln_id) AS cves FROM findings GROUP BY 1, 2",
    "package_upgrades": f"""WITH {_hits_sql('true', inventory='inv', inventories=_TWO_RUNS)},
        d AS (SELECT run, asset_id || '|' || vuln_id || '|' || name || '|' || source AS finding_id, string_agg(DISTINCT version, ',' ORDER BY version) AS versions FROM inv JOIN hits USING (name, version, source, os) GROUP BY ALL)
        SELECT finding_id, 'open' AS status, CAST(CASE WHEN finding_id IN (SELECT finding_id FROM d WHERE run = 1) THEN 1000 ELSE 2000 END AS BIGINT) AS first_seen, CAST(2000 AS BIGINT) AS last_seen, versions FROM d WHERE run = 2""",
    "sbom_shape": f"WITH {SBOM} SELECT asset_id, count(*) AS component_count, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM sbom GROUP BY 1",
}
