"""Rules, scores and version orders on hand-written vectors."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import ai, rules, scoring, versions


def values(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_process_rules(spark):
    rows = [("/tmp/nc", None, None), ("/tmp/nc", None, True), ("C:\\Windows\\PowerShell.EXE", "powershell -Enc AAA", None), ("/opt/app", "curl | sh", None), (None, None, None), ("/var/tmp/x", None, False)]
    hits = rules.process_hits(F.col("image"), F.col("cmdline"), F.col("trusted"))
    got = values(spark, rows, "image string, cmdline string, trusted boolean", F.struct(F.transform(hits, lambda h: h["rule"]), rules.severity(hits)))
    assert [(list(r[0]), r[1]) for r in got] == [
        (["lolbin", "suspicious_path", "lolbin_in_suspicious_path"], 4),
        (["lolbin"], 3),
        (["lolbin", "lolbin_suspicious_cmdline"], 4),
        ([], 1),
        ([], 1),
        (["suspicious_path"], 3),
    ]


@pytest.mark.parametrize(
    ("addr", "external"),
    [
        ("1.2.3.4", True), ("10.1.2.3", False), ("172.16.0.1", False), ("172.32.0.1", True), ("192.168.0.1", False), ("127.9.9.9", False),
        ("169.254.1.1", False), ("0.0.0.0", False), ("256.1.1.1", False), ("01.2.3.4", False), ("1.2.3", False), ("::1", False), ("::", False),
        ("2001:db8::1", True), ("fe80::1", False), ("febf::1", False), ("fec0::1", True), ("fc00::1", False), ("fdff::1", False), ("::ffff:10.0.0.1", False),
        ("::ffff:1.2.3.4", True), ("::ffff:102:304", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7", False), ("1::2::3", False), ("1:2:3:4:5:6:7::8", False),
        ("not-an-ip", False), ("", False), (None, False), ("::1.2.3.4", True), ("12345::1", False),
    ],
)
def test_external(spark, addr, external):
    assert values(spark, [(addr,)], "a string", rules.is_external(F.col("a"))) == [external]


def test_files(spark):
    rows = [("/etc/cron.d/x", True), ("/home/u/.ssh/id_rsa", False), ("/usr/bin/evil.log.dll", True), ("/etc/a.log", True), ("/tmp/etc/passwd", True), ("C:\\Windows\\System32\\config\\SAM", False), (None, True)]
    got = values(spark, rows, "p string, w boolean", F.struct(rules.watched(F.col("p")), F.transform(rules.file_hits(F.col("p"), F.col("w")), lambda h: h["rule"])))
    assert [(r[0], list(r[1])) for r in got] == [
        (True, ["write_to_persistence_location", "write_to_sensitive_config"]),
        (True, ["read_of_sensitive_file"]),
        (True, ["write_to_system_dir"]),
        (False, ["write_to_sensitive_config"]),
        (False, ["write_to_sensitive_config"]),
        (True, ["read_of_sensitive_file"]),
        (False, []),
    ]


def test_scores(spark):
    e = scoring.policy_explain(F.col("w"), F.col("net"), F.col("comp"), F.col("crit"))
    rows = [(0.5, False, False, "normal"), (1.0, True, False, "crown_jewel"), (0.1, False, True, "normal")]
    got = values(spark, [(float(a), b, c, d) for a, b, c, d in rows], "w float, net boolean, comp boolean, crit string", scoring.policy_risk(e))
    assert got == [36, 100, 4]
    rows = [(9.8, 0.0, "none", "affected", False, False, "normal"), (9.8, 1.0, "in_the_wild", "not_affected", True, False, "crown_jewel"), (10.0, 1.0, "in_the_wild", "affected", True, False, "crown_jewel"), (None, None, "none", "unknown", False, False, "low")]
    v = scoring.vulnerability_explain(*[F.col(c) for c in ("cvss", "epss", "m", "vex", "net", "comp", "crit")])
    got = values(spark, rows, "cvss float, epss float, m string, vex string, net boolean, comp boolean, crit string", scoring.vulnerability_risk(v))
    assert got == [28, 0, 100, 0]
    made = values(spark, [(70, False), (40, False), (20, False), (19, False), (1, True)], "r int, kev boolean", scoring.decision(F.col("r"), F.col("kev"), F.lit(True), F.lit(1.0)))
    assert made == ["ACT", "ATTEND", "TRACK", "DEFER", "ACT"]


DPKG = [("7", "7.4"), ("7.4", "7.4-3"), ("7.4~pre2", "7.4"), ("7.4~~x", "7.4~"), ("7.4~dev", "7.4~pre"), ("99", "3:7"), ("7.4-2+deb9u5", "7.4-2+deb9u12"), ("7.4p", "7.4+git"), ("0.99", "0.0100"), ("5" * 1200, "1" + "0" * 1200)]
RPM = [("7", "7.4"), ("7.4", "7.4.0"), ("7.4~pre2", "7.4"), ("7.4", "7.4^20240501"), ("7.4-3.fc40", "7.4-12.fc40"), ("7.x", "7.4"), ("99", "3:7"), ("6.9_z", "6.10"), ("5" * 1200, "1" + "0" * 1200)]
SEMVER = [("7.4.1", "7.4.12"), ("6.99.99", "7.0.0"), ("7.4.0-pre", "7.4.0"), ("7.4.0-pre.9", "7.4.0-pre.10"), ("7.4.0-dev", "7.4.0-pre"), ("7.4.0-77", "7.4.0-dev"), ("v7.9", "7.11"), ("7.4.0-pre", "7.4.0-pre.0")]


@pytest.mark.parametrize(("key", "pairs"), [(versions.dpkg_key, DPKG), (versions.rpm_key, RPM), (versions.semver_key, SEMVER)])
def test_version_order(spark, key, pairs):
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", (key(F.col("a")) < key(F.col("b"))).alias("less")).collect()
    assert [r for r in got if not r["less"]] == []


def test_semver_rejects(spark):
    assert values(spark, [("latest",), ("7.x.4",), ("7.4.1.9",), ("",), ("7",), ("7.4.0",)], "v string", versions.semver_key(F.col("v")).isNull()) == [True, True, True, True, False, False]
    same = spark.createDataFrame([("7", "7.0.0"), ("7.4.1+build.5", "7.4.1")], "a string, b string").select(versions.semver_key(F.col("a")) == versions.semver_key(F.col("b"))).collect()
    assert all(r[0] for r in same)


def plain_dpkg(a, b):
    """Order of two version fragments, character by character."""
    weight = lambda c: 0 if c == "" or c.isdigit() else -1 if c == "~" else ord(c) if c.isalpha() else ord(c) + 256
    i = j = 0
    while i < len(a) or j < len(b):
        while (i < len(a) and not a[i].isdigit()) or (j < len(b) and not b[j].isdigit()):
            x, y = weight(a[i : i + 1]), weight(b[j : j + 1])
            if x != y:
                return x - y
            i, j = i + 1, j + 1
        m, n = i, j
        while m < len(a) and a[m].isdigit():
            m += 1
        while n < len(b) and b[n].isdigit():
            n += 1
        x, y = int(a[i:m] or 0), int(b[j:n] or 0)
        if x != y:
            return x - y
        i, j = m, n
    return 0


def test_dpkg_key_is_the_order(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("01929a.b~+z") for _ in range(rng.randint(0, 6)))
    pairs = [(word(), word()) for _ in range(3000)]
    k = versions.dpkg_key
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.when(k(F.col("a")) < k(F.col("b")), -1).when(k(F.col("a")) > k(F.col("b")), 1).otherwise(0).alias("o")).collect()
    sign = lambda x: (x > 0) - (x < 0)
    assert [r for r in got if sign(plain_dpkg(r["a"], r["b"])) != r["o"]] == []


def plain_rpm(a, b):
    """Order by segments: a tilde, the end, a caret, letters, a number."""
    rank = lambda t: 1 if t is None else 0 if t == "~" else 2 if t == "^" else 4 if t.isdigit() else 3
    x, y = (re.findall(r"[A-Za-z]+|[0-9]+|~|\^", v) for v in (a, b))
    for p, q in itertools.zip_longest(x, y):
        if rank(p) != rank(q):
            return rank(p) - rank(q)
        p, q = (int(p), int(q)) if rank(p) == 4 else (p, q)
        if p != q:
            return 1 if p > q else -1
    return 0


def plain_semver(a, b):
    def parts(v):
        core, _, pre = v.partition("-")
        ids = [(0, int(i), "") if i.isdigit() else (1, 0, i) for i in pre.split(".")]
        return (*(int(x) for x in (core.split(".") + ["0", "0"])[:3]), (1,) if not pre else (0, *ids))

    x, y = parts(a), parts(b)
    return (x > y) - (x < y)


@pytest.mark.parametrize(
    ("key", "plain", "make"),
    [
        (versions.rpm_key, plain_rpm, lambda r: "".join(r.choice("0129ab.~^_Z") for _ in range(r.randint(0, 7)))),
        (versions.semver_key, plain_semver, lambda r: ".".join(str(r.choice([0, 1, 2, 10, 99])) for _ in range(r.randint(1, 3))) + r.choice(["", "", "-" + ".".join(r.choice(["0", "2", "10", "a", "b2", "B"]) for _ in range(r.randint(1, 3)))])),
    ],
)
def test_keys_are_the_order(spark, key, plain, make):
    rng = random.Random(6)
    pairs = [(make(rng), make(rng)) for _ in range(3000)]
    a, b = key(F.col("a")), key(F.col("b"))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.when(a < b, -1).when(a > b, 1).otherwise(0).alias("o")).collect()
    sign = lambda x: (x > 0) - (x < 0)
    assert [r for r in got if sign(plain(r["a"], r["b"])) != r["o"]] == []


def test_ai(spark):
    rows = [("/usr/bin/github-copilot-",), ("C:\\x\\Claude.exe",), ("/bin/bash",), ("aider.py",), (".py",), (None,)]
    assert values(spark, rows, "i string", ai.tool_of(F.col("i"))) == ["github-copilot", "claude-code", None, "aider", None, None]
    assert values(spark, [("node --x /a/claude.js",), ("python -m",), (None,)], "c string", ai.tool_in_cmdline(F.col("c"))) == ["claude-code", None, None]
    assert values(spark, [("/m/a.GGUF",), ("b.pt",), ("c.txt",)], "p string", ai.model_format(F.col("p"))["risky"]) == [False, True, None]
    assert values(spark, [("127.0.0.1",), ("8.8.8.8",), ("10.0.0.1",), ("x",)], "a string", rules.connection_scope(F.col("a"))) == ["loopback", "external", "private", None]
