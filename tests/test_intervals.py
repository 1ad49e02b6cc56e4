"""Points in ranges and fragments in texts, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import intervals as I
from emberwatch.operators import vulnerabilities as V

KEYS = ["", "a", "a\x00", "a\x00\x00", "aa", "ab", "b", "b\x00", "ba", "c", "~"]


def between(key):
    return (key >= F.col("lo")) & F.coalesce(key < F.col("hi"), F.lit(True))


@pytest.mark.parametrize("few", [0, I.FEW])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stabbed(spark, seed, few):
    rng = random.Random(seed)
    points = [(g, rng.choice([None, *KEYS])) for g in ("x", "y", "z") for _ in range(12)]
    ranges = [(rng.choice("xyw"), k, rng.choice(KEYS), rng.choice([None, *KEYS])) for k in range(30)]
    p, r = spark.createDataFrame(points, "g string, key string"), spark.createDataFrame(ranges, "g string, rid int, lo string, hi string")
    got = I.stabbed(p, r, ["g"], F.array("lo", "hi"), between, ["rid"], few)
    want = sorted({(g, k, rid) for g, k in points for h, rid, lo, hi in ranges if g == h and k is not None and k >= lo and (hi is None or k < hi)})
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


@pytest.mark.parametrize("few", [0, I.FEW])
def test_stabbed_always_never_and_no_key(spark, few):
    p = spark.createDataFrame([("x", None), ("x", "a"), ("x", "b"), ("x", "b")], "g string, key string")
    r = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("x", 4)], "g string, rid int")
    holds = lambda k: F.when(F.col("rid") == 1, F.lit(True)).when(F.col("rid") == 2, k.isNull()).when(F.col("rid") == 3, k != "a")
    got = I.stabbed(p, r, ["g"], F.when(F.col("rid") == 3, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")), holds, ["rid"], few)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("x", None, 1), ("x", "a", 1), ("x", "b", 1), ("x", None, 2), ("x", "b", 3)], key=str)
    assert I.stabbed(p.limit(0), r, ["g"], F.array(F.lit("a")), holds, ["rid"], few).isEmpty()
    assert I.stabbed(p, r.limit(0), ["g"], F.array(F.lit("a")), holds, ["rid"], few).isEmpty()


def test_many_ranges_of_one_name(spark):
    """2,000 points and 2,000 narrow ranges of one group: what the join makes is what holds, not 4,000,000 pairs."""
    p = spark.range(2000).select(F.lit("x").alias("g"), F.lpad(F.col("id").cast("string"), 6, "0").alias("key"))
    r = spark.range(2000).select(F.lit("x").alias("g"), F.col("id").alias("rid"), F.lpad(F.col("id").cast("string"), 6, "0").alias("lo"), F.lpad((F.col("id") + 3).cast("string"), 6, "0").alias("hi"))
    got = I.stabbed(p, r, ["g"], F.array("lo", "hi"), between, ["rid"])
    assert got.count() == 2000 * 3 - 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containing(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["", None]
    needles = ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 5))) for _ in range(40)] + ["zzz", "", "a", "ab", None]
    got = I.containing(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(n,) for n in needles], "needle string"))
    assert sorted(map(tuple, got.collect())) == sorted({(t, n) for t in texts for n in needles if t is not None and n is not None and n in t})


def plain_osv(components, advisories):
    """All pairs of a family and name, with the range walk of each."""
    a = advisories.withColumn("family", V.family(F.col("ecosystem"))).where("family <> 'other'")
    c = components.withColumn("family", F.explode(V.families_of(F.col("source"), F.col("os"))))
    native = F.when(F.col("family") == "rpm", "rpm").otherwise("dpkg")
    keys = {k: V.key_for(F.lit(k), F.col("version")) for k in ("semver", "rpm", "dpkg")}
    c = c.withColumns(keys | {"native": V.key_for(native, F.col("version"))})
    j = c.join(V.keyed_ranges(a), ["family", "name"])
    inside = F.exists("keyed", lambda r: V._walk(r["events"], F.when(r["kind"] == "semver", F.col("semver")).otherwise(F.col("native"))))
    hit = j.where(F.array_contains("listed", F.col("version")) | inside)
    return hit.groupBy("name", "version", "source", "os", "vuln_id").agg(F.min("remediation_key").alias("remediation_key"))


@pytest.mark.parametrize("few", [0, I.FEW])
@pytest.mark.parametrize("seed", [1, 2])
def test_osv_hits_are_those_of_all_pairs(spark, seed, few):
    rng = random.Random(seed)
    version = lambda: rng.choice(["1.0", "1.0~rc1", "2:1.0", "1.2.3", "1.2.3-1", "v1.2", "3", "10.0", "x", "1.2.3+b", ""])
    event = lambda: rng.choice([("0", None, None), (version(), None, None), (None, version(), None), (None, None, version())])
    advisories = [
        (f"A{k % 25}", rng.choice(["Debian:12", "Ubuntu:22.04", "Red Hat:9", "npm"]), rng.choice("pq"), [version() for _ in range(rng.randint(0, 2))],
         [(rng.choice(["ECOSYSTEM", "SEMVER", "GIT"]), [event() for _ in range(rng.randint(0, 4))]) for _ in range(rng.randint(0, 2))])
        for k in range(40)
    ]
    components = [(rng.choice("pqr"), version(), rng.choice(["dpkg", "rpm", "registry"]), rng.choice(["Ubuntu", "Debian", "", None])) for _ in range(60)]
    c = spark.createDataFrame(components, "name string, version string, source string, os string").distinct()
    a = spark.createDataFrame(advisories, V.OSV)
    got, want = sorted(map(str, V.osv_hits(c, a, few).collect())), sorted(map(str, plain_osv(c, a).select(*V.HITS).collect()))
    assert got == want and len(want) > 10
