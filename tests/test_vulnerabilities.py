"""Identity of vulnerabilities, inventories as records, and feeds as they are written."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberwatch.operators import findings as O
from emberwatch.operators import records as C
from emberwatch.operators import vulnerabilities as V
from emberwatch.sources import feeds

SBOM = "asset_id string, name string, version string, source string, os string"
HITS = "name string, version string, source string, os string, vuln_id string, remediation_key string"
EVIDENCE = "id string, score double, severity array<struct<type:string,score:string>>, maturity string, seq int"


def run(spark, sbom, prior, now):
    hits = [("ssl", v, "dpkg", "Debian", "CVE-1", "upgrade:ssl>=3") for v in ("1", "2")] + [("ssl", "1", "rpm", "Debian", "CVE-1", "upgrade:ssl>=9")]
    none = V.enrichment(*[spark.createDataFrame([], s) for s in ("vuln_id string, cvss_env float, maturity string", "vuln_id string, epss float", "vuln_id string")])
    return V.vulnerability_run(spark.createDataFrame(sbom, SBOM), spark.createDataFrame(hits, HITS), none, prior, F.lit(now))[0]


def test_a_package_of_a_source_is_one_finding(spark):
    both = [("h", "ssl", "1", "dpkg", "Debian"), ("h", "ssl", "2", "dpkg", "Debian"), ("h", "ssl", "3", "dpkg", "Debian"), ("h", "ssl", "1", "rpm", "Debian")]
    f = run(spark, both, O.empty_state(spark), 5).orderBy("finding_id").collect()
    assert [(r["finding_id"], r["versions"], r["remediation_key"]) for r in f] == [("h|CVE-1|ssl|dpkg", ["1", "2"], "upgrade:ssl>=3"), ("h|CVE-1|ssl|rpm", ["1"], "upgrade:ssl>=9")]


def test_an_upgrade_that_does_not_help_is_the_same_finding(spark):
    first = run(spark, [("h", "ssl", "1", "dpkg", "Debian")], O.empty_state(spark), 5).withColumn("status", F.lit("closed"))
    again = run(spark, [("h", "ssl", "2", "dpkg", "Debian")], first, 9).collect()
    assert [(r["finding_id"], r["status"], r["first_seen"], r["last_seen"], r["versions"]) for r in again] == [("h|CVE-1|ssl|dpkg", "reopened", 5, 9, ["2"])]
    assert run(spark, [("h", "ssl", "3", "dpkg", "Debian")], first, 9).isEmpty()


def test_inventory_records_are_nested(spark):
    c = spark.createDataFrame([("h", "ssl", "1", "dpkg", "Debian"), ("h", "zip", "", "dpkg", "Debian")], SBOM)
    e = C.sbom_envelopes(c, F.lit(5))
    data = json.loads(e.first()["data"])
    assert list(data) == ["sbom"] and data["sbom"]["component_count"] == 2 and set(data["sbom"]) == {"format", "components", "component_count"}
    assert sorted(map(tuple, C.components_of(e).collect())) == sorted(map(tuple, c.collect()))
    real = e.withColumn("data", F.lit('{"sbom":{"format":"x","components":[{"name":"a","version":"1","source":"rpm","libraries":["/l"]},{"name":7},3],"component_count":3}}'))
    assert [tuple(r) for r in C.components_of(real).collect()] == [("h", "a", "1", "rpm", "Debian")]


def test_maturity_is_taken_as_written(spark):
    rows = [("a", 1.0, [], "poc", 1), ("b", 1.0, [], "POC", 2), ("c", 1.0, [], None, 3), ("d", 1.0, [], "in_the_wild", 4)]
    got = feeds.cvss_evidence(spark.createDataFrame(rows, EVIDENCE), None)
    assert {r["vuln_id"]: r["maturity"] for r in got.collect()} == {"a": "poc", "b": "none", "c": "none", "d": "in_the_wild"}


def test_score_header_is_a_whole_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# x\nCVE-1,0.5,0.9\n CVE,epss,Percentile \n\nCVE-2, 0.25 ,0.1,more\n")
    assert {r["vuln_id"]: r["epss"] for r in feeds.read_epss(spark, str(tmp_path / "a.csv")).collect()} == {"CVE-1": 0.5, "CVE-2": 0.25}
    for k, bad in enumerate(("cve,x,y", "cve,epss", "cve")):
        (tmp_path / f"bad{k}.csv").write_text(f"CVE-1,0.5,0.9\n{bad}\n")
        with pytest.raises(PySparkException):
            feeds.read_epss(spark, str(tmp_path / f"bad{k}.csv")).collect()


def test_manifest_names_and_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a b.json", "é.json"):
        (tmp_path / "in" / name).write_text(name)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    m = [("a b.json", f" {sha('a b.json').upper()}\n"), ("é.json", sha("é.json")), ("../x", "00"), ("..", "00"), ("", "00")]
    got = {tuple(r) for r in feeds.feed_violations(spark, str(tmp_path / "in"), spark.createDataFrame(m, "name string, sha256 string")).collect()}
    assert got == {(n, v) for n in ("../x", "..", "") for v in ("missing", "bad_name")}


def test_products_with_several_entries(spark):
    """Of two entries of a vulnerability that fit a name, each has its own ranges; aliases may be short."""
    e = lambda i, f: [(i, f, None)]
    a = spark.createDataFrame([("W", "P", ["PuTTY"], e("1", "2")), ("W", "Q", ["tt"], e("3", "4")), ("X", "R", ["zz", "y"], e("0", "9")), ("Y", "S", ["nothing"], e("0", "9")), ("Z", "T", None, None)], V.NVD)
    c = spark.createDataFrame([("PuTTY (64-bit)", v, "registry", "") for v in ("1.5", "2.5", "3.5", "odd")], "name string, version string, source string, os string")
    got = {(r["version"], r["vuln_id"], r["remediation_key"]) for r in V.nvd_hits(c, a).collect()}
    assert got == {("1.5", "W", "upgrade:P>=2"), ("3.5", "W", "upgrade:Q>=4")} | {(v, "X", "upgrade:R>=9") for v in ("1.5", "2.5", "3.5")}
