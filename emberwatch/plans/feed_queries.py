"""Queries over feeds, reachability, asset context, detection quality and rollouts; their files are derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.fixtures import sbom_components, sensor_events, table
from emberwatch.operators import findings as O
from emberwatch.operators import posture as P
from emberwatch.operators import records as C
from emberwatch.operators import remediation as M
from emberwatch.operators import scorecard as B
from emberwatch.operators import vulnerabilities as V
from emberwatch.plans import detection as D
from emberwatch.plans import inventory_queries as IQ
from emberwatch.plans import posture_reports as PR
from emberwatch.plans import sqltext as Q
from emberwatch.plans import vulnerability as VQ
from emberwatch.sources import feeds
from emberwatch.sources import inventory as I
from emberwatch.sources.shared import cut, scratch

_key = lambda c: F.col(c).cast("string")


def _arrays(rows: DataFrame, folder: str, head: str = "[", tail: str = "]", per_file: int = 5000) -> None:
    """Rows of text (`value`) as files of an array each, of about `per_file` rows."""
    files = max(1, -(-rows.count() // per_file))
    whole = rows.withColumn("f", F.pmod(F.xxhash64("value"), F.lit(files))).groupBy("f").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("v"))
    whole.select(F.concat(F.lit(head), F.col("v"), F.lit(tail)).alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).mode("append").text(folder)


def _feed(spark: SparkSession, sf: str) -> str:
    """A feed store: advisories, scores and known exploited ones of the parts, and the state of the active snapshot."""
    root = scratch(spark, "feed")
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.concat(F.lit("CVE-"), _key("p_partkey")).alias("id"))
    score = F.concat(F.lit(',"cvss_base_score":'), (F.col("p_size") / 5.0).cast("string"))
    vector = F.when(F.col("p_partkey") % 3 == 0, '[{"type":"CVSS_V2","score":"v2"},{"type":"cvss_v3","score":""},{"type":"Cvss_V3","score":"v3"}]').otherwise("[]")
    maturity = F.when(F.col("p_partkey") % 4 == 0, "poc").when(F.col("p_partkey") % 8 == 1, "POC").when(F.col("p_partkey") % 4 == 1, "unheard of").otherwise("weaponized")
    osv = p.select(F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","severity":'), vector, F.lit(',"database_specific":{"exploit_maturity":"'), maturity, F.lit('"'), score, F.lit('},"affected":[{"package":{"ecosystem":"Debian:12","name":"pkg-'), _key("p_size"), F.lit('"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"2"}]}]}]}')).alias("value"))
    _arrays(osv, f"{root}/content/osv")
    nvd = p.where("p_partkey % 7 = 0").select(F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","severity":[],"database_specific":{"cvss_base_score":9.5}}')).alias("value"))
    _arrays(nvd, f"{root}/content/nvd", '{"feed_tier":"community","records":[', "]}")
    lines = p.where("p_partkey % 2 = 0").select(F.concat(F.col("id"), F.lit(","), (F.col("p_size") / 100.0).cast("string"), F.lit(", 0.5")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# scores",), ("CVE,EPSS,Percentile",), ("",)], "value string")).write.text(f"{root}/content/epss")
    kev = p.where("p_partkey % 9 = 0").select(F.concat(F.lit('{"cveID":"'), F.col("id"), F.lit('"}')).alias("value"))
    _arrays(kev, f"{root}/content/kev", '{"vulnerabilities":[', "]}")
    spark.createDataFrame([('{"feed_version":"2024-06","source":"s","tier":"community","created_at":1000,"applied_at":2000}',)], "value string").write.text(f"{root}/state.json")
    return root


def feed_scores(spark, sf):
    """Evidence of a feed store's active snapshot, by vulnerability, with its version and age."""
    root = _feed(spark, sf)
    state = feeds.installed_feed(spark, root)
    seen = feeds.cvss_evidence(feeds.read_evidence(spark, f"{root}/content/osv"), feeds.read_evidence(spark, f"{root}/content/nvd"))
    e = V.enrichment(seen, feeds.read_epss(spark, f"{root}/content/epss"), feeds.read_kev(spark, f"{root}/content/kev"))
    version = state.first()
    e = feeds.stamped(e, version["feed_version"]).withColumn("staleness_ms", feeds.staleness_ms(F.lit(version["created_at"]), F.lit(1500)).cast("long"))
    return e.select("vuln_id", F.round(F.col("cvss_env").cast("double"), 3).alias("cvss"), "vector", F.round(F.col("epss").cast("double"), 3).alias("epss"), "percentile", "kev", "maturity", "feed_version", "staleness_ms")


_FEED = """SELECT 'CVE-' || p_partkey AS vuln_id, CASE WHEN p_partkey % 7 = 0 THEN 9.5 ELSE round(p_size / 5.0, 3) END AS cvss, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 <> 0 THEN 'v3' END AS vector,
CASE WHEN p_partkey % 2 = 0 THEN round(p_size / 100.0, 3) END AS epss, CAST(CASE WHEN p_partkey % 2 = 0 THEN 0.5 END AS REAL) AS percentile, p_partkey % 9 = 0 AS kev,
CASE WHEN p_partkey % 9 = 0 THEN 'weaponized' WHEN p_partkey % 7 = 0 THEN 'none' WHEN p_partkey % 4 = 0 THEN 'poc' WHEN p_partkey % 4 = 1 THEN 'none' ELSE 'weaponized' END AS maturity, '2024-06' AS feed_version, CAST(500 AS BIGINT) AS staleness_ms
FROM part"""


def feed_advisories(spark, sf):
    """Advisories of the same bundle by package, of the family that a Debian host matches."""
    a = feeds.read_osv(spark, f"{_feed(spark, sf)}/content/osv").withColumn("family", V.family(F.col("ecosystem")))
    return a.groupBy("name", "family").agg(F.count("*").alias("advisories"), F.min(V.first_fixed(F.col("ranges"))).alias("fixed"))


def feed_integrity(spark, sf):
    """Files of a feed, one a nation, against a manifest in which some digests are wrong and some names are missing."""
    folder = scratch(spark, "bundle")
    n = table(spark, sf, "nation").select(F.concat(_key("n_nationkey"), F.lit(" "), F.col("n_name")).alias("value"))
    n.coalesce(1).write.option("maxRecordsPerFile", 1).text(folder)
    f = spark.read.text(folder, wholetext=True).select(F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("name"), "value")
    k, digest = F.split_part("value", F.lit(" "), F.lit(1)).cast("int"), F.sha2(F.encode("value", "UTF-8"), 256)
    m = f.where(k % 5 != 4).select("name", F.when(k % 5 == 1, "00").otherwise(F.concat(F.lit(" "), F.upper(digest), F.lit("\t"))).alias("sha256"))
    gone = f.where(k % 5 == 4).select(F.concat(F.lit("lost-"), "name").alias("name"), F.lit("00").alias("sha256"))
    return feeds.feed_violations(spark, folder, m.unionByName(gone)).groupBy("violation").agg(F.count("*").alias("files"))


def windows_advisories(spark, sf):
    """Products of Windows bundles: with a tier and a date, and bare."""
    root = scratch(spark, "windows")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.concat(F.lit('{"id":"W-'), _key("s_suppkey"), F.lit('","affected_windows":[{"product":"P'), _key("s_nationkey"), F.lit('","aliases":["PuTTY '), _key("s_nationkey"), F.lit('"],"ranges":[{"fixed":"2.0"}]}]}')).alias("value"))
    _arrays(s.where("k % 3 = 0").select("value"), root, '{"feed_tier":"licensed","snapshot_date":"d","records":[', "]}")
    _arrays(s.where("k % 3 = 1").select("value"), root, '{"feed_tier":"odd","records":[', "]}")
    _arrays(s.where("k % 3 = 2").select("value"), root)
    n = feeds.read_nvd(spark, root)
    return n.groupBy("tier", "snapshot_date", F.get("aliases", 0).alias("alias"), "product").agg(F.count("*").alias("advisories"))


def package_libraries(spark, sf):
    """Shared libraries by package, from rpm's and dpkg's lists."""
    s = IQ._host(spark, sf)
    k = _key("s_nationkey")
    rpm = s.where("s_suppkey % 2 = 0").select("asset_id", F.concat(F.lit("ssl"), k, F.lit("\t/usr/lib/libssl.so.3\nssl"), k, F.lit("\t/usr/bin/openssl\nzed"), k, F.lit("\t/opt/z.DYLIB\nssl"), k, F.lit("\t/usr/lib/liba.so\nno tab")).alias("text"))
    dpkg = s.where("s_suppkey % 2 = 1").select("asset_id", F.concat(F.lit("/var/lib/dpkg/info/libc"), k, F.lit(":amd64.list")).alias("list_path"), F.lit("/.\n/lib/libc.so.6\r\n/usr/share/doc\n/lib/x.dll\n").alias("text"))
    l = I.rpm_libraries(rpm).unionByName(I.dpkg_libraries(dpkg))
    return l.select("asset_id", "name", F.array_join("libraries", ",").alias("libraries"))


def libraries_and_loads(spark, sf, sbom=None):
    """Libraries of components (of `sbom`, if it is at hand), and what was seen loaded on hosts; on some nothing was."""
    libraries = (sbom_components(spark, sf) if sbom is None else sbom).select("asset_id", F.col("name").alias("component"), F.concat(F.lit("/usr/lib/lib"), F.col("name"), F.lit(".so")).alias("path")).distinct()
    s = IQ._host(spark, sf)
    loads = s.where("s_suppkey % 4 <> 1").select("asset_id", F.explode(F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("/usr/lib/libputty.so"), F.lit("/usr/lib/libopenssl.so"))).otherwise(F.array(F.lit("/usr/lib/libnone.so")))).alias("path"))
    return libraries, loads


def _mixed(spark, sf, sbom=None):
    """These as records: inventories with the libraries of their packages, and loads."""
    libraries, loads = libraries_and_loads(spark, sf, sbom)
    sbom = libraries.groupBy("asset_id", F.col("component").alias("name")).agg(F.array_sort(F.collect_list("path")).alias("libraries"))
    return cut(C.sbom_envelopes(sbom.withColumns({"version": F.lit("1"), "source": F.lit("dpkg"), "os": F.lit("")}), F.lit(5)).unionByName(C.load_envelopes(loads, F.lit(7))))


def _context(spark, sf, sbom):
    """Hosts with a context, and the reachability that the records of libraries and loads tell."""
    s = IQ._host(spark, sf)
    assets = s.where("s_suppkey % 5 <> 0").select("asset_id", (F.col("s_nationkey") % 3 == 0).alias("internet_facing"), F.when(F.col("s_nationkey") % 4 == 0, "crown_jewel").when(F.col("s_nationkey") % 4 == 1, "low").otherwise("high").alias("criticality"), (F.col("s_nationkey") % 6 == 0).alias("compensating_controls"))
    return assets, C.reachability_of(_mixed(spark, sf, sbom))


def _with_vex(spark):
    """Evidence in which one advisory doesn't affect the products and one is unknown."""
    e = VQ.enriched(spark)
    return e.withColumn("vex", F.when(F.col("vuln_id") == "OSV-3", "not_affected").when(F.col("vuln_id") == "CVE-W2", "unknown").otherwise(F.col("vex")))


def _vulnerability_run(spark, sf, closes=False):
    sbom = cut(sbom_components(spark, sf))
    hits = V.composite_hits(*VQ._hits(spark, V.distinct_components(sbom), "osv", "nvd", "feed"))
    assets, runtime = _context(spark, sf, sbom)
    return V.vulnerability_run(sbom, hits, _with_vex(spark), O.empty_state(spark), F.lit(7), assets, runtime, closes)


def vulnerability_context(spark, sf):
    """Findings in the context of their hosts, with reachability and what doesn't affect."""
    f = _vulnerability_run(spark, sf)[0]
    return f.select("finding_id", "risk", "decision", "status", "runtime_reachable", F.size("provenance").alias("sources"), F.array_join("versions", ",").alias("versions"), "first_seen")


def vulnerability_fixes(spark, sf):
    """Fixes of the same findings with what they close, without suppressed ones."""
    g = _vulnerability_run(spark, sf, closes=True)[1]
    return g.select("remediation_key", "risk", F.array_join("closes", ",").alias("closes"), F.col("assets_count").alias("assets"))


_R = VQ._R
_CONTEXT = f"""WITH {VQ._hits_sql('true')}, {VQ._ENR},
host AS (SELECT 'sup-' || s_suppkey AS asset_id, s_suppkey AS k, s_nationkey AS n FROM supplier),
d AS (SELECT s.asset_id, h.vuln_id, s.name AS component, s.source AS location, 1 AS sources, string_agg(DISTINCT s.version, ',' ORDER BY s.version) AS versions, min(h.remediation_key) AS remediation_key FROM sbom s JOIN hits h USING (name, version, source, os) GROUP BY ALL),
x AS (SELECT d.*, CASE d.vuln_id WHEN 'OSV-3' THEN 'not_affected' WHEN 'CVE-W2' THEN 'unknown' ELSE CASE WHEN e.vuln_id IS NULL THEN 'unknown' ELSE 'affected' END END AS vex, coalesce(kev, false) AS kev, least({_R(1)}, coalesce(cvss_env, {_R(0)}) / {_R(10)}) AS sev,
  greatest(coalesce(epss, {_R(0)}), {_R("CASE maturity WHEN 'poc' THEN 0.4 WHEN 'functional' THEN 0.7 WHEN 'weaponized' THEN 0.9 ELSE 0.0 END")}) AS lik,
  CASE WHEN h.k % 4 = 1 THEN NULL ELSE h.k % 2 = 0 AND d.component IN ('putty', 'openssl') END AS runtime_reachable,
  {_R("CASE WHEN h.k % 5 <> 0 AND h.n % 3 = 0 THEN 1.4 ELSE 0.8 END")} * {_R("CASE WHEN h.k % 5 <> 0 AND h.n % 6 = 0 THEN 0.5 ELSE 1 END")} AS exposure,
  {_R("CASE WHEN h.k % 5 = 0 THEN 0.9 WHEN h.n % 4 = 0 THEN 1.5 WHEN h.n % 4 = 1 THEN 0.5 ELSE 1.2 END")} AS crit
  FROM d JOIN host h ON d.asset_id = h.asset_id LEFT JOIN enr e ON d.vuln_id = e.vuln_id),
y AS (SELECT *, CASE WHEN vex = 'unknown' AND coalesce(runtime_reachable, false) THEN {_R(1)} WHEN vex = 'unknown' THEN {_R(0.3)} WHEN vex = 'affected' THEN {_R(1)} ELSE {_R(0)} END AS reach FROM x),
r AS (SELECT *, CAST(round({_R(100)} * least({_R(1)}, sev * ({_R(0.4)} + {_R(0.6)} * lik) * exposure * crit * reach)) AS INTEGER) AS risk FROM y),
findings AS (SELECT *, asset_id || '|' || vuln_id || '|' || component || '|' || location AS finding_id, CASE WHEN (kev AND reach > 0) OR risk >= 70 THEN 'ACT' WHEN risk >= 40 THEN 'ATTEND' WHEN risk >= 20 THEN 'TRACK' ELSE 'DEFER' END AS decision, CASE WHEN vex = 'not_affected' THEN 'suppressed' ELSE 'open' END AS status FROM r)"""


def vulnerability_details(spark, sf):
    """One row a finding: what, where, how bad, and what to do."""
    return VQ.findings(spark, sf).select(F.col("vuln_id").alias("cve"), F.col("component").alias("package"), F.array_join("versions", ",").alias("version"), F.col("cvss_env").cast("double").alias("cvss"), "kev", F.col("epss").cast("double").alias("epss"), "risk", "decision", F.col("remediation_key").alias("fix"), F.col("asset_id").alias("host"), "status")


def product_names(spark, sf):
    """Display names as alias matching sees them."""
    note = F.get(F.array(*[F.lit(x) for x in (" (64-bit)", " (X86)", "  (64-bit x64) 2.0", "", "\t(32 bit)")]), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf, "part").select("p_partkey", V.display_name(F.concat(F.lit("  "), F.col("p_name"), note)).alias("shown"))


def provenance(spark, sf):
    """Detections of several sources, brought together by identity."""
    l = table(spark, sf, "lineitem").select(
        F.concat(F.lit("sup-"), _key("l_suppkey")).alias("asset_id"), F.concat(F.lit("v-"), (F.col("l_partkey") % 20).cast("string")).alias("vuln_id"), F.lit("c").alias("component"), F.lit("l").alias("location"),
        F.concat(F.lit("src"), (F.col("l_linenumber") % 3).cast("string")).alias("source"), F.lit("scan").alias("method"), (F.col("l_linenumber") % 2 * 0.5).cast("float").alias("confidence"), F.concat(F.lit("fix-"), _key("l_orderkey")).alias("remediation_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    c = O.correlate(l)
    return c.select("asset_id", "vuln_id", F.array_join(F.transform("provenance", lambda p: p["source"]), ",").alias("sources"), "remediation_key")


def fix_totals(spark, sf):
    """Fixes against findings: how many findings a fix closes."""
    q = O.fix_queue(D.all_findings(sensor_events(spark, sf)))
    return q.agg(F.count("*").alias("fixes"), F.sum("findings").alias("findings")).withColumn("findings_per_fix", F.round(F.col("findings") / F.col("fixes"), 6))


def fix_members(spark, sf):
    return O.fix_members(D.all_findings(sensor_events(spark, sf))).groupBy("remediation_key", "kind").agg(F.count("*").alias("members"), F.min("member").alias("first"))


def fix_slices(spark, sf):
    """Members of fixes in slices of about fifty."""
    m = O.fix_slices(VQ.findings(spark, sf), 50)
    g = m.groupBy("remediation_key", "kind").agg(F.max("total").alias("total"), F.sum(F.size("members")).alias("members"), F.max("slices").alias("slices"), F.min(F.get("members", 0)).alias("first"))
    return g.select("remediation_key", "kind", "total", "members", F.col("slices").cast("long").alias("slices"), "first")


# Detection quality.
def _cases(spark, sf):
    """Declared cases with their defaults, and captures out of a file."""
    c = table(spark, sf, "customer")
    declared = c.select(F.concat(F.lit("case-"), _key("c_custkey")).alias("case_id"), F.when(F.col("c_custkey") % 3 == 0, "B").alias("tier"), F.concat(F.lit("T"), (F.col("c_custkey") % 4).cast("string")).alias("technique"), F.when(F.col("c_custkey") % 6 == 0, "miss").alias("expected_result"), F.lit(None).cast("string").alias("platform"), F.lit(None).cast("double").alias("seconds"), F.when(F.col("c_custkey") % 10 != 9, F.lit(1007)).alias("want_class"), F.when(F.col("c_custkey") % 10 != 9, F.concat(F.lit("rule-"), (F.col("c_custkey") % 4).cast("string"))).alias("want_rule"), F.col("c_custkey").alias("case_no"))
    o = table(spark, sf, "orders")
    record = F.concat(F.lit('{"class_uid":1007,"time":'), (F.col("o_orderkey") % 9000).cast("string"), F.lit(',"data":{"detections":[{"rule":"rule-'), (F.col("o_orderkey") % 4).cast("string"), F.lit('"}]}}'))
    r = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(record)).alias("records"))
    case = c.join(r, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.to_json(F.struct(F.concat(F.lit("case-"), _key("c_custkey")).alias("case_id"), F.lit(1000).alias("trigger_time"), F.coalesce("records", F.array().cast("array<string>")).alias("records"))).alias("value"))
    folder = scratch(spark, "captures")
    _arrays(case, folder, '{"agent":"a","run_id":"r","baseline":[],"cases":[', "]}")
    fired = F.concat(F.lit('{"data":{"process":{"detections":[{"rule":"idle-'), (F.col("o_orderkey") % 3).cast("string"), F.lit('"}]}}}'))
    quiet = F.to_json(F.struct(F.when(F.col("o_orderkey") % 4 == 0, '{"data":{}}').otherwise(fired).alias("x")))
    _arrays(o.select(F.regexp_extract(quiet, r'(?s)\A\{"x":(.*)\}\z', 1).alias("value")), folder, '{"agent":"a","run_id":"r","cases":[],"baseline":[', "]}")
    captured, baseline = feeds.read_captures(spark, folder)
    return feeds.declared_cases(declared), captured, baseline


def captured_cases(spark, sf):
    """The matrix of cases out of a captures file."""
    cases, captured, _ = _cases(spark, sf)
    r = captured.where("record IS NOT NULL").select("case_id", F.get_json_object("record", "$.class_uid").cast("int").alias("class_uid"), F.get_json_object("record", "$.time").cast("long").alias("time"), feeds.rules_of(F.col("record")).alias("rules"))
    v = B.score_cases(cases, captured.select("case_id", "trigger").distinct(), r)
    return B.case_matrix(v).select("technique", "tier", "verdict", "cases", "fastest_ms", F.array_join("fp_rules", ",").alias("fp_rules"))


def idle_alarms(spark, sf):
    """What fired while nothing happened: records of a run's files, and alerts of other agents, of which each counts."""
    _, captured, baseline = _cases(spark, sf)
    own = B.idle_false_positives(baseline.select(feeds.rules_of(F.col("record")).alias("rules"))).withColumn("mode", F.lit("own"))
    alerts = _alerts(spark, sf).where("agent <> 'other'").select(F.array_compact(F.array(B.peer_label(F.col("agent"), F.col("alert")))).alias("rules"))
    f = own.unionByName(B.idle_false_positives(alerts, peer=True).withColumn("mode", F.lit("peer")))
    return f.select("mode", "false_positives", F.array_join("rules", ",").alias("rules")).join(captured.agg(F.countDistinct("case_id").alias("cases")))


def _alerts(spark, sf):
    """Raw alerts of other agents, one an order."""
    o = table(spark, sf, "orders")
    t = (F.col("o_orderkey") % 5).cast("string")
    agent = F.when(F.col("o_orderkey") % 3 == 0, "wazuh").when(F.col("o_orderkey") % 3 == 1, "falco").otherwise("other")
    named = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('"id":"'), t, F.lit('",'))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit('"id":'), t, F.lit(","))).otherwise("")
    wazuh = F.concat(F.lit('{"rule":{'), named, F.lit('"mitre":{"id":["T'), t, F.lit('",7,"odd-'), t, F.lit('"]}}}'))
    falco = F.concat(F.lit('{"rule":"shell","tags":["mitre_x","T'), t, F.lit('","T1.","Tx","T9.'), t, F.lit('"]}'))
    return o.select(F.col("o_custkey").alias("case_id"), "o_orderkey", agent.alias("agent"), F.when(agent == "wazuh", wazuh).when(agent == "falco", falco).otherwise("{}").alias("alert"))


def peer_alerts(spark, sf):
    """Alerts by agent, label and technique."""
    a = _alerts(spark, sf).select("agent", B.peer_label(F.col("agent"), F.col("alert")).alias("label"), F.array_join(B.peer_techniques(F.col("agent"), F.col("alert")), ",").alias("techniques"))
    return a.groupBy("agent", "label", "techniques").agg(F.count("*").alias("alerts"))


def peer_verdicts(spark, sf):
    cases, captures, _ = PR._bench(spark, sf)
    a = _alerts(spark, sf).where("agent <> 'other'").select("case_id", (F.lit(500) + F.col("o_orderkey") % 7000).cast("long").alias("time"), B.peer_techniques(F.col("agent"), F.col("alert")).alias("techniques"), B.peer_label(F.col("agent"), F.col("alert")).alias("label"))
    v = B.peer_verdicts(cases, captures, a.join(captures.select("case_id"), "case_id", "left_semi"))
    return v.select("case_id", "technique", "verdict", F.array_join("fp_rules", ",").alias("fp_rules"))


def common_violations(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    e = o.select(F.when(k % 6 == 0, F.lit(1)).otherwise(1007).alias("class_uid"), F.lit("x").alias("class_name"), F.when(k % 4 != 0, k).alias("time"), (k % 9).alias("severity_id"), F.lit("m").alias("metadata"), F.when(k % 5 != 0, "d").alias("device"), F.lit("{}").alias("data"))
    return B.top_violations(B.violations(e), 3)


# Rollouts.
def rollout_plan(spark, sf):
    """Canaries and what is left of each order's targets after those that are applied."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("targets"), F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("applied"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return l.select("l_orderkey", join(M.canary_cohort(F.col("targets"), (F.col("l_orderkey") % 4).cast("int"))).alias("canaries"), join(M.remaining_targets(F.col("targets"), F.col("applied"))).alias("left"))


def closed_fixes(spark, sf):
    """Findings after the actions that were verified as fixed."""
    f = D.all_findings(sensor_events(spark, sf))
    n = F.length("finding_id")
    done = f.where(n % 3 == 0).select("finding_id", F.explode(F.array(F.lit(900).cast("long"), F.lit(800).cast("long"))).alias("closed_at"))
    c = O.close_on_verified_fix(f, done)
    return c.select("finding_id", "status", "closed_at")


def lifecycle_tiles(spark, sf):
    """Open, closed and reopened findings, and the mean days to fix over all of them and by decision."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("decision"), F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "P", "reopened").otherwise("open").alias("status"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("first_seen"), F.when(F.col("o_orderstatus") == "F", F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") % 40 * 86400000).alias("closed_at"))
    g = O.mttr_days(o).groupingSets([[], [F.col("decision")]], F.col("decision")).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("open", "closed", "reopened")], F.round(F.avg("mttr_days"), 6).alias("mttr_days"))
    return g.select(F.coalesce("decision", F.lit("all")).alias("decision"), "open", "closed", "reopened", "mttr_days")


def health_by_day(spark, sf):
    """Use of the processor against its budget over time, and when a host was last seen."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("host-"), (F.col("o_custkey") % 20).cast("string")).alias("asset_id"), F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_orderkey") % 9).cast("float").alias("used"), (F.col("o_orderkey") % 5).cast("float").alias("budget"))
    h = P.health(o, F.col("used"), F.col("budget"))
    w = F.window("at", "30 days")
    g = h.groupBy("asset_id", w.alias("w")).agg(F.count("*").alias("samples"), F.count_if("over_budget").alias("over_budget"), F.max("at").alias("last_seen"), F.min("used").cast("double").alias("least"))
    return g.select("asset_id", F.date_format("w.start", "yyyy-MM-dd").alias("from_day"), "samples", "over_budget", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"), "least")


QUERIES = {
    "feed_scores": feed_scores,
    "feed_advisories": feed_advisories,
    "feed_integrity": feed_integrity,
    "windows_advisories": windows_advisories,
    "package_libraries": package_libraries,
    "vulnerability_context": vulnerability_context,
    "vulnerability_fixes": vulnerability_fixes,
    "vulnerability_details": vulnerability_details,
    "product_names": product_names,
    "provenance": provenance,
    "fix_totals": fix_totals,
    "fix_members": fix_members,
    "fix_slices": fix_slices,
    "captured_cases": captured_cases,
    "idle_alarms": idle_alarms,
    "peer_alerts": peer_alerts,
    "peer_verdicts": peer_verdicts,
    "common_violations": common_violations,
    "rollout_plan": rollout_plan,
    "closed_fixes": closed_fixes,
    "lifecycle_tiles": lifecycle_tiles,
    "health_by_day": health_by_day,
}
_E, _ALL = PR._E, f"{PR._E}, {Q.RECORDS}, {Q.findings(Q.ALL_RAW)}"
_TILE = "count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) AS open, count(*) FILTER (o_orderstatus = 'F') AS closed, count(*) FILTER (o_orderstatus = 'P') AS reopened, round(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey % 40 AS DOUBLE) END), 6) AS mttr_days"
_ALERTS = """WITH a AS (SELECT o_custkey AS case_id, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'wazuh' WHEN 1 THEN 'falco' ELSE 'other' END AS agent FROM orders),
l AS (SELECT *, CASE agent WHEN 'wazuh' THEN CASE WHEN k % 4 = 0 THEN 'wazuh:' || (k % 5) ELSE 'wazuh:?' END WHEN 'falco' THEN 'falco:shell' END AS label, CASE agent WHEN 'wazuh' THEN ['T' || (k % 5), 'odd-' || (k % 5)] WHEN 'falco' THEN ['T' || (k % 5), 'T9.' || (k % 5)] ELSE [] END AS techniques FROM a)"""
_CASES = """WITH cases AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'B' ELSE 'A' END AS tier, 'T' || (c_custkey % 4) AS technique, c_custkey % 6 = 0 AS miss, CASE WHEN c_custkey % 10 <> 9 THEN 'rule-' || (c_custkey % 4) END AS want FROM customer),
recs AS (SELECT o_custkey AS k, o_orderkey % 9000 AS t, 'rule-' || (o_orderkey % 4) AS rule FROM orders),
j AS (SELECT c.*, r.t, r.rule, c.want IS NULL OR r.t BETWEEN 1000 AND 6000 AS inside FROM cases c LEFT JOIN recs r USING (k)),
v AS (SELECT k, tier, technique, miss, want, bool_or(coalesce(inside AND rule = want, false)) AS hit, bool_or(coalesce(inside AND want IS NOT NULL AND rule IS NOT NULL, false)) AS seen, min(CASE WHEN inside AND rule = want THEN greatest(t - 1000, 0) END) AS ms FROM j GROUP BY ALL),
firsts AS (SELECT want AS rule, min_by(technique, k) AS rtech FROM cases WHERE want IS NOT NULL GROUP BY 1),
x AS (SELECT j.k, j.rule FROM j JOIN firsts f USING (rule) WHERE inside AND (want IS NULL OR j.rule <> want) AND technique <> rtech),
d AS (SELECT *, CASE WHEN want IS NULL THEN 'GAP' WHEN miss THEN CASE WHEN hit THEN 'GAP_CLOSED' ELSE 'GAP' END WHEN hit THEN 'HIT' WHEN seen THEN 'PARTIAL' ELSE 'MISS' END AS verdict FROM v)"""
SQL = {
    "feed_scores": _FEED,
    "feed_advisories": "SELECT 'pkg-' || p_size AS name, 'debian' AS family, count(*) AS advisories, '2' AS fixed FROM part GROUP BY 1",
    "feed_integrity": "SELECT violation, count(*) AS files FROM (SELECT unnest(CASE n_nationkey % 5 WHEN 1 THEN ['changed'] WHEN 4 THEN ['missing', 'unlisted'] ELSE [] END) AS violation FROM nation) v GROUP BY 1",
    "windows_advisories": "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'licensed' ELSE 'community' END AS tier, CASE WHEN s_suppkey % 3 = 0 THEN 'd' END AS snapshot_date, 'putty ' || s_nationkey AS alias, 'P' || s_nationkey AS product, count(*) AS advisories FROM supplier GROUP BY 1, 2, 3, 4",
    "package_libraries": "WITH s AS (SELECT 'sup-' || s_suppkey AS asset_id, s_suppkey % 2 AS odd, s_nationkey AS n FROM supplier) SELECT asset_id, 'ssl' || n AS name, '/usr/lib/liba.so,/usr/lib/libssl.so.3' AS libraries FROM s WHERE odd = 0 UNION ALL SELECT asset_id, 'zed' || n, '/opt/z.DYLIB' FROM s WHERE odd = 0 UNION ALL SELECT asset_id, 'libc' || n, '/lib/libc.so.6,/lib/x.dll' FROM s WHERE odd = 1",
    "vulnerability_context": f"{_CONTEXT} SELECT finding_id, risk, decision, status, runtime_reachable, CAST(sources AS INTEGER) AS sources, versions, CAST(7 AS BIGINT) AS first_seen FROM findings",
    "vulnerability_fixes": f"{_CONTEXT} SELECT remediation_key, max(risk) AS risk, string_agg(DISTINCT vuln_id, ',' ORDER BY vuln_id) AS closes, count(DISTINCT asset_id) AS assets FROM findings WHERE status <> 'suppressed' GROUP BY 1",
    "vulnerability_details": f"{VQ._FIND} SELECT f.vuln_id AS cve, component AS package, versions AS version, CAST(f.cvss_env AS DOUBLE) AS cvss, f.kev, CAST(e.epss AS DOUBLE) AS epss, risk, decision, remediation_key AS fix, asset_id AS host, status FROM findings f LEFT JOIN enr e ON f.vuln_id = e.vuln_id",
    "product_names": r"SELECT p_partkey, trim(regexp_replace(lower(p_name) || CASE p_partkey % 5 WHEN 2 THEN ' 2.0' ELSE '' END, '\s+', ' ', 'g')) AS shown FROM part",
    "provenance": "SELECT 'sup-' || l_suppkey AS asset_id, 'v-' || (l_partkey % 20) AS vuln_id, string_agg('src' || (l_linenumber % 3), ',' ORDER BY l_linenumber % 2 DESC, l_orderkey * 10 + l_linenumber) AS sources, arg_min('fix-' || l_orderkey, (-(l_linenumber % 2), l_orderkey * 10 + l_linenumber)) AS remediation_key FROM lineitem GROUP BY 1, 2",
    "fix_totals": f"{_ALL} SELECT count(DISTINCT remediation_key) AS fixes, count(*) AS findings, round(count(*) / CAST(count(DISTINCT remediation_key) AS DOUBLE), 6) AS findings_per_fix FROM findings",
    "fix_members": f"{_ALL} SELECT remediation_key, 'closes' AS kind, count(DISTINCT vuln_id) AS members, min(vuln_id) AS first FROM findings GROUP BY 1 UNION ALL SELECT remediation_key, 'asset', count(DISTINCT asset_id), min(asset_id) FROM findings GROUP BY 1",
    "fix_slices": f"{VQ._FIND}, m AS (SELECT DISTINCT remediation_key, 'closes' AS kind, vuln_id AS member FROM findings UNION SELECT remediation_key, 'asset', asset_id FROM findings) SELECT remediation_key, kind, count(*) AS total, count(*) AS members, CAST(ceil(count(*) / 50) AS BIGINT) AS slices, min(member) AS first FROM m GROUP BY 1, 2",
    "captured_cases": f"{_CASES} SELECT technique, tier, verdict, count(DISTINCT d.k) AS cases, min(ms) AS fastest_ms, coalesce(string_agg(DISTINCT x.rule, ',' ORDER BY x.rule), '') AS fp_rules FROM d LEFT JOIN x ON d.k = x.k GROUP BY 1, 2, 3",
    "idle_alarms": f"""{_ALERTS}, c AS (SELECT count(*) AS cases FROM customer) SELECT 'own' AS mode, count(*) AS false_positives, string_agg(DISTINCT 'idle-' || (o_orderkey % 3), ',' ORDER BY 'idle-' || (o_orderkey % 3)) AS rules, min(cases) AS cases FROM orders, c WHERE o_orderkey % 4 <> 0
        UNION ALL SELECT 'peer', count(*), string_agg(DISTINCT label, ',' ORDER BY label), min(cases) FROM l, c WHERE agent <> 'other'""",
    "peer_alerts": f"{_ALERTS} SELECT agent, label, array_to_string(techniques, ',') AS techniques, count(*) AS alerts FROM l GROUP BY 1, 2, 3",
    "peer_verdicts": f"""{_ALERTS}, c AS (SELECT c_custkey AS case_id, 'T' || (c_custkey % 4) || CASE WHEN c_custkey % 5 = 0 THEN '+T9' ELSE '' END AS technique, c_custkey % 6 = 0 AS miss, c_custkey % 10 = 9 AS free, c_custkey % 13 <> 0 AS captured FROM customer),
        j AS (SELECT c.*, l.label, techniques, captured AND l.k IS NOT NULL AND (free OR 500 + l.k % 7000 BETWEEN 1000 AND 6000) AS inside, list_has_any(string_split(technique, '+'), techniques) AS own FROM c LEFT JOIN l ON c.case_id = l.case_id AND captured AND agent <> 'other'),
        h AS (SELECT case_id, technique, miss, captured, bool_or(coalesce(inside AND own, false)) AS hit, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (inside AND NOT own AND len(techniques) > 0), '') AS fp_rules FROM j GROUP BY ALL)
        SELECT case_id, technique, CASE WHEN NOT captured THEN 'NO_DATA' WHEN miss THEN CASE WHEN hit THEN 'GAP_CLOSED' ELSE 'GAP' END WHEN hit THEN 'HIT' ELSE 'MISS' END AS verdict, fp_rules FROM h""",
    "common_violations": "WITH v AS (SELECT unnest(list_filter([CASE WHEN o_orderkey % 4 = 0 THEN 'missing:time' END, CASE WHEN o_orderkey % 5 = 0 THEN 'missing:device' END, CASE WHEN o_orderkey % 6 = 0 THEN 'unknown_class' END, CASE WHEN o_orderkey % 9 NOT BETWEEN 1 AND 6 THEN 'severity_out_of_range' END], lambda x: x IS NOT NULL)) AS violation FROM orders) SELECT violation, count(*) AS records FROM v GROUP BY 1 ORDER BY records DESC, violation LIMIT 3",
    "rollout_plan": "WITH t AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS t, list(l_linenumber) FILTER (l_returnflag = 'R') AS a FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(t[1:least(greatest(l_orderkey % 4, 1), len(t))], ',') AS canaries, array_to_string(list_filter(t, lambda x: NOT list_contains(coalesce(a, []), x)), ',') AS left FROM t",
    "closed_fixes": f"{_ALL} SELECT finding_id, CASE WHEN length(finding_id) % 3 = 0 THEN 'closed' ELSE status END AS status, CAST(CASE WHEN length(finding_id) % 3 = 0 THEN 800 END AS BIGINT) AS closed_at FROM findings",
    "lifecycle_tiles": f"SELECT 'all' AS decision, {_TILE} FROM orders UNION ALL SELECT o_orderpriority, {_TILE} FROM orders GROUP BY 1",
    "health_by_day": "WITH h AS (SELECT 'host-' || (o_custkey % 20) AS asset_id, CAST(o_orderdate AS TIMESTAMP) AS seen, o_orderkey % 9 AS used, o_orderkey % 5 AS budget FROM orders) SELECT asset_id, strftime(time_bucket(INTERVAL 30 DAY, seen, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS from_day, count(*) AS samples, count(*) FILTER (budget = 0 OR used > budget) AS over_budget, strftime(max(seen), '%Y-%m-%d') AS last_seen, CAST(min(used) AS DOUBLE) AS least FROM h GROUP BY 1, 2",
}
