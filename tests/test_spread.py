"""Work that is much a row doesn't follow the row groups of a file, and an inventory is worked out once."""

from emberwatch.fixtures import sensor_events
from emberwatch.operators import vulnerabilities as V
from emberwatch.plans import vulnerability as VQ


def test_advisories_are_spread(spark, monkeypatch):
    many, cut, seen = int(spark.conf.get("spark.sql.shuffle.partitions")), V.cut, []
    monkeypatch.setattr(V, "cut", lambda df: seen.append((df.columns, df.rdd.getNumPartitions())) or cut(df))
    c = spark.createDataFrame([("openssl", "3.1.1", "dpkg", "Ubuntu"), ("putty", "3.1.1", "registry", "")], "name string, version string, source string, os string")
    osv = V.osv_hits(c, spark.createDataFrame(VQ.ADVISORIES, V.OSV).coalesce(1))
    assert seen[0] == (["family", "name", "vuln_id", "listed", "keyed", "remediation_key"], many) and c.columns in [x for x, _ in seen]
    assert [r["vuln_id"] for r in osv.collect()] == ["OSV-1"]
    seen.clear()
    nvd = V.nvd_hits(c, spark.createDataFrame(VQ.PRODUCTS, V.NVD).coalesce(1))
    assert seen[0] == (["id", "product", "aliases", "ranges", "entry"], many) and c.columns in [x for x, _ in seen]
    assert [r["vuln_id"] for r in nvd.collect()] == ["CVE-W2"]


def test_k_is_parsed_once(spark):
    e = sensor_events(spark, "/root/testdata/sf0.001").where("path LIKE '%so%' AND image LIKE '%b%' AND daddr IS NOT NULL")
    assert e._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1


def test_few_hits_go_to_the_inventories(spark):
    """Without statistics, as checkpoints have none, an inventory isn't shuffled to meet a few hits."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        sbom = spark.createDataFrame([("h", "curl", "1", "dpkg", ""), ("h", "curl", "2", "dpkg", ""), ("i", "sudo", "1", "dpkg", "")], "asset_id string, name string, version string, source string, os string")
        hits = spark.createDataFrame([("curl", v, "dpkg", "", "V", f"fix{v}") for v in "12"], ", ".join(f"{c} string" for c in V.HITS))
        d = V.detections(sbom, hits)
        assert "SortMergeJoin" not in d._jdf.queryExecution().executedPlan().toString()
        assert [(r["asset_id"], r["remediation_key"], r["versions"]) for r in d.collect()] == [("h", "fix1", ["1", "2"])]
    finally:
        spark.conf.set(key, before)
