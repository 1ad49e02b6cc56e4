"""Readers, parsers, state and as-of joins on small inputs."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import asof, findings, vulnerabilities
from emberwatch.sources import feeds, inventory, shared, sinks

LINE = {"class_uid": 4001, "class_name": "n", "time": 5, "severity_id": 1, "metadata": {"product": "p", "version": "1", "tenant_id": "t"}, "device": {"hostname": "h", "os": "o", "os_version": "1"}, "data": {"detections": [{"rule": "a"}, {"x": 1}, {"rule": "b", "reason": "r"}]}}


def test_envelopes(spark):
    bad = {k: v for k, v in LINE.items() if k != "device"}
    lines = [json.dumps(LINE), "", "   ", "{", json.dumps(bad), json.dumps(LINE | {"class_uid": "4001"})]
    good, rejected = feeds.parse_envelopes(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert good.count() == 1 and rejected.count() == 3
    assert [r["rule"] for r in good.select(F.explode(feeds.detections(F.col("data"))).alias("d")).select("d.*").collect()] == ["a", "b"]
    assert good.select(feeds.detections(F.lit('{"detections": 3}')).alias("d")).first()["d"] == []


def test_epss_and_kev(spark, tmp_path):
    (tmp_path / "e.csv").write_text("#c\n\ncve,epss,percentile\nCVE-1,0.5,0.9\nCVE-1,0.6,0.8\nCVE-2,0.1,0.2\n")
    got = {r["vuln_id"]: round(r["epss"], 3) for r in feeds.read_epss(spark, str(tmp_path / "e.csv")).collect()}
    assert got == {"CVE-1": 0.6, "CVE-2": 0.1}
    (tmp_path / "bad.csv").write_text("CVE-1,x,0.9\n")
    with pytest.raises(Exception, match="not a score line"):
        feeds.read_epss(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "k.json").write_text('{"vulnerabilities": [{"cveID": "CVE-1"}, {"cveID": "CVE-1"}]}')
    assert feeds.read_kev(spark, str(tmp_path / "k.json")).count() == 1


def test_bundles(spark, tmp_path):
    osv = [{"id": "A", "affected": [{"package": {"ecosystem": "Debian:12", "name": "x"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "2"}]}]}]}]
    (tmp_path / "o.json").write_text(json.dumps(osv))
    a = feeds.read_osv(spark, str(tmp_path / "o.json"))
    c = spark.createDataFrame([("x", "1.9", "dpkg", "Debian"), ("x", "2", "dpkg", "Debian"), ("x", "1", "rpm", "")], "name string, version string, source string, os string")
    assert [(r["version"], r["remediation_key"]) for r in vulnerabilities.osv_hits(c, a).collect()] == [("1.9", "upgrade:x>=2")]
    nvd = [{"id": "W", "affected_windows": [{"product": "P", "aliases": ["PuTTY"], "ranges": [{"fixed": "2.0"}]}]}]
    for k, body in enumerate((nvd, {"feed_tier": "licensed", "snapshot_date": "d", "records": nvd})):
        (tmp_path / f"n{k}.json").write_text(json.dumps(body))
        n = feeds.read_nvd(spark, str(tmp_path / f"n{k}.json"))
        assert n.first()["tier"] == ["community", "licensed"][k]
        w = spark.createDataFrame([("PuTTY  release (64-bit)", "1.9", "registry", ""), ("PuTTY", "1.9.0.1", "registry", "")], "name string, version string, source string, os string")
        assert [r["vuln_id"] for r in vulnerabilities.nvd_hits(w, n).collect()] == ["W"]


def test_feed_check(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_text("1")
    (tmp_path / "b.json").write_text("2")
    m = spark.createDataFrame([("a.json", hashlib.sha256(b"1").hexdigest().upper()), ("b.json", "00"), ("c.json", "00")], "name string, sha256 string")
    assert {tuple(r) for r in feeds.feed_violations(spark, str(tmp_path), m).collect()} == {("b.json", "changed"), ("c.json", "missing")}


def test_libraries(spark):
    raw = spark.createDataFrame([("h", "a\t/usr/lib/x.so.1\na\t/usr/bin/y\nb\t/z.dylib\n")], "asset_id string, text string")
    assert {(r["name"], tuple(r["libraries"])) for r in inventory.rpm_libraries(raw).collect()} == {("a", ("/usr/lib/x.so.1",)), ("b", ("/z.dylib",))}
    lists = spark.createDataFrame([("h", "/var/lib/dpkg/info/libc6:amd64.list", "/lib/c.so.6\n/etc/x\n")], "asset_id string, list_path string, text string")
    assert [tuple(r)[1:] for r in inventory.dpkg_libraries(lists).collect()] == [("libc6", ["/lib/c.so.6"])]


def test_reachability(spark):
    libs = spark.createDataFrame([("h", "a", "/x.so"), ("h", "b", "/y.so"), ("g", "a", "/x.so")], "asset_id string, component string, path string")
    loads = spark.createDataFrame([("h", "/x.so"), ("h", "/x.so")], "asset_id string, path string")
    assert {tuple(r) for r in vulnerabilities.reachability(libs, loads).collect()} == {("h", "a", True), ("h", "b", False)}


def test_state_table(spark, tmp_path):
    state = sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark))
    row = lambda i, s: (i, "a", "v", "c", "l", 1, "TRACK", 720, s, "k", 1, 1, None)
    make = lambda *r: spark.createDataFrame(list(r), findings.FINDING)
    rows = lambda: {(r["finding_id"], r["status"]) for r in state.load().collect()}
    assert state.version() is None and rows() == set()
    assert state.write(make(row("1", "open"), row("2", "open")), "a", 0)
    assert state.write(make(row("2", "closed"), row("3", "open")), "a", 1)
    assert not state.write(make(row("9", "open")), "a", 1)  # a repeated batch
    assert rows() == {("1", "open"), ("2", "closed"), ("3", "open")}
    assert state.write(make(row("4", "open")), "b", 0)  # a new checkpoint: its batches start again
    assert rows() == {("1", "open"), ("2", "closed"), ("3", "open"), ("4", "open")}
    assert state.write(make(row("5", "open")))  # a batch run
    assert state.version() == 3 and state.seen("a", 1) and not state.seen("a", 2) and state.seen("b", 0)


def test_state_survives_failures_between_its_writes(spark, tmp_path, monkeypatch):
    state = sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark))
    make = lambda i: spark.createDataFrame([(i, "a", "v", "c", "l", 1, "TRACK", 720, "open", "k", 1, 1, None)], findings.FINDING)
    point = sinks.StateTable._point

    def fails(self, number, pointer):
        if pointer["version"] >= 0:
            raise RuntimeError("lost")
        point(self, number, pointer)

    monkeypatch.setattr(sinks.StateTable, "_point", fails)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            state.write(make("1"), "a", 0)
    monkeypatch.setattr(sinks.StateTable, "_point", point)
    assert state.load().count() == 0
    assert state.write(make("2"), "a", 0) and [r["finding_id"] for r in state.load().collect()] == ["2"]
    shutil.rmtree(tmp_path / "s" / "pointer")
    with pytest.raises(ValueError, match="pointers are lost"):
        sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark)).load()


def state_rows(spark, ids, status="open"):
    made = spark.createDataFrame([(i, status) for i in ids], "finding_id string, status string")
    have = {"finding_id", "status"}
    return made.select(*[f.name if f.name in have else F.lit("x" if f.dataType.simpleString() == "string" else 1).cast(f.dataType).alias(f.name) for f in findings.empty_state(spark).schema])


def test_state_writes_follow_the_batch(spark, tmp_path):
    """Small batches on a large state write little, segments stay few, and the last row of an id counts."""
    state = sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark))
    state.write(state_rows(spark, [f"f{k}" for k in range(100_000)]), "a", 0)
    folder = tmp_path / "s" / "data"
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    base = size()
    for b in range(1, 9):
        state.write(state_rows(spark, [f"f{b}", f"f{b + 1}", f"new{b}"], f"s{b}"), "a", b)
    assert size() - base < base / 4  # most of it file footers
    p = state.pointer()
    assert p["version"] == 8 and len(p["segments"]) <= 4 and sum(n for _, n in p["segments"][1:]) <= 17
    got = {r["finding_id"]: r["status"] for r in state.load().collect()}
    assert len(got) == 100_008 and [got[f"f{k}"] for k in (0, 1, 2, 8, 9, 10)] == ["open", "s1", "s2", "s8", "s8", "open"]
    some = state.load(spark.createDataFrame([("f9",), ("new3",), ("none",)], "finding_id string"))
    assert {(r["finding_id"], r["status"]) for r in some.collect()} == {("f9", "s8"), ("new3", "s3")}
    # Another reader finds the last pointer by itself, and nothing that it needs is dead.
    other = sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark))
    assert other.pointer() == p
    state.clean()
    assert len(list(folder.glob("s=*"))) == len(p["segments"])
    assert sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark)).pointer() == p
    assert state.load().count() == 100_008


def test_state_survives_a_failure_while_segments_are_merged(spark, tmp_path, monkeypatch):
    state = sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark))
    state.write(state_rows(spark, ["1"]), "a", 0)
    point = sinks.StateTable._point

    def fails(self, number, pointer):
        if len(pointer["segments"]) == 1:  # what the merge would write
            raise RuntimeError("lost")
        point(self, number, pointer)

    monkeypatch.setattr(sinks.StateTable, "_point", fails)
    with pytest.raises(RuntimeError):
        state.write(state_rows(spark, ["2"]), "a", 1)
    monkeypatch.setattr(sinks.StateTable, "_point", point)
    state = sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark))
    assert state.seen("a", 1) and {r["finding_id"] for r in state.load().collect()} == {"1", "2"}
    assert not state.write(state_rows(spark, ["2"]), "a", 1)
    assert state.write(state_rows(spark, ["3"], "late"), "a", 2) and len(state.pointer()["segments"]) == 1
    assert {r["finding_id"] for r in state.load().collect()} == {"1", "2", "3"}


def test_state_takes_the_last_of_repeated_rows(spark, tmp_path):
    state = sinks.StateTable(spark, str(tmp_path / "s"), findings.empty_state(spark))
    twice = state_rows(spark, ["1"], "first").withColumn("seq", F.lit(1)).unionByName(state_rows(spark, ["1"], "last").withColumn("seq", F.lit(2)))
    state.write(twice)
    assert [r["status"] for r in state.load().collect()] == ["last"]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(Session)


def test_writers_of_a_day_follow_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, 86_400_000 * (k % 10 == 0)) for k in range(1000)], "same int, ms long")
    sinks.write_by_day(rows, str(tmp_path / "d"), F.col("ms"), rows_per_file=100)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "d").glob("day=*")}
    assert files == {"day=1970-01-01": 9, "day=1970-01-02": 1} and spark.read.parquet(str(tmp_path / "d")).count() == 1000


def test_ndjson(spark):
    df = spark.createDataFrame([("a", None, 3)], "id string, x string, risk int")
    assert sinks.to_ndjson(df, {"risk": "R"}).first()["value"] == '{"id":"a","x":null,"R":3}'


def test_odd_inventory_text(spark):
    frame = lambda *t: spark.createDataFrame([("h", x) for x in t], "asset_id string, text string")
    names = lambda d: sorted((r["name"], r["version"]) for r in d.collect())
    assert names(inventory.dpkg_packages(frame("Package: a\nStatus: install ok installed\n\nPackage: b\nStatus: hold ok half-installed\nVersion: 1\n \nPackage: c\r\nStatus: install ok installed\r\nVersion: 2:1-1\r\n", "", None))) == [("a", ""), ("c", "2:1-1")]
    assert names(inventory.rpm_packages(frame("a\t1\textra\n\t2\nb\t\n", None))) == [("a", "1"), ("b", "")]
    assert names(inventory.brew_packages(frame("  a   1 2\nb\n", "\n"))) == [("a", "1")]
    assert names(inventory.registry_packages(frame("HKEY_X\n DisplayName REG_SZ A  b \n DisplayName REG_SZ C\nHKEY_Y\n DisplayVersion REG_SZ 1\n"))) == [("C", "")]
    at = lambda d: sorted((r["local_addr"], r["port"], r["pid"], r["process"]) for r in d.collect())
    many = "LISTEN 0 1 *:22 *:* " + "x " * 1500 + 'users:(("sshd",pid=7,fd=3))'
    assert at(inventory.ss_listeners(frame(many + "\nLISTEN 0 1 [::]:65536 *:*\nLISTEN 0\n"))) == [("0.0.0.0", 22, 7, "sshd")]
    assert at(inventory.lsof_listeners(frame("(LISTEN) x\na 1 u TCP [::1]:80 (LISTEN)\n"))) == [("::1", 80, 1, "a")]
    blocks = [("10.0.0.77/30", 4), ("10.0.0.0/33", 0), ("10.0.0/24", 0), ("300.0.0.0/30", 0), ("10.0.0.1/32", 1), ("10.0.0.0/8", 0), (None, 0)]
    got = spark.createDataFrame(blocks, "c string, n int").select("n", F.size(inventory.expand_cidr(F.col("c"), 16)).alias("s")).collect()
    assert all(r["n"] == r["s"] for r in got)


def test_rules_at_any_depth(spark):
    record = json.dumps({"rule": "outside", "data": {"rule": "a", "x": [{"rule": "b\"c"}, {"y": {"rule": 9, "text": '"rule": "no"', "rules": "no"}}], "rule2": "no"}})
    assert spark.createDataFrame([(record,), ("{",)], "r string").select(feeds.rules_at_any_depth(F.col("r"))).collect() == [(["a", 'b"c'],), (None,)]


EVENTS = "event_id long, asset_id string, kind string, ts long, pid long, ppid long, image string, daddr string, dport int, path string"


def events(spark, *rows):
    full = [(i, "h", k, t, p, *(list(more) + [None] * (5 - len(more)))) for i, k, t, p, *more in rows]
    return spark.createDataFrame(full, EVENTS)


def test_grace_and_late_exec(spark):
    e = events(
        spark,
        (1, "ProcessExec", 0, 1, None, "/tmp/nc"), (2, "ProcessExit", 100, 1), (3, "NetConnect", 5099, 1, None, "nc"), (4, "NetConnect", 5100, 1, None, "nc"),
        (5, "NetConnect", 1000, 2, None, ""), (6, "ProcessExec", 1249, 2, None, "/bin/a"), (7, "NetConnect", 999, 3, None, ""), (8, "ProcessExec", 1249, 3, None, "/bin/b"),
    )
    got = {r["event_id"]: r["ctx"] and r["ctx"]["event_id"] for r in asof.attribute(e, ["NetConnect"]).collect()}
    assert got == {3: 1, 4: None, 5: 6, 7: None}


def test_ancestry(spark):
    e = events(spark, (1, "ProcessExec", 0, 1, None, "/tmp/nc"), (2, "ProcessExec", 10, 2, 1, "/bin/sh"), (3, "ProcessExec", 20, 3, 2, "/bin/ls"), (4, "ProcessExec", 30, 4, 9, "/bin/ls"))
    got = {r["event_id"]: (r["effective"], r["suspicious_ancestor"]) for r in asof.ancestry(e).collect()}
    assert got == {1: (4, False), 2: (4, True), 3: (4, True), 4: (1, False)}


def test_reopened(spark):
    cols = findings.FINDING
    f = lambda s, c=None: ("x", "a", "v", "c", "l", 1, "TRACK", 720, s, "k", 5, 6, c)
    go = lambda was, now: findings.reconcile(spark.createDataFrame([f(was, 7)], cols), spark.createDataFrame([f(now)], cols), F.lit(9)).first()
    assert (go("closed", "open")["status"], go("reopened", "open")["status"], go("closed", "suppressed")["status"]) == ("reopened", "open", "suppressed")
    assert (go("closed", "open")["first_seen"], go("closed", "open")["last_seen"], go("closed", "open")["closed_at"]) == (5, 9, None)
