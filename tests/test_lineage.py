"""Suspicion that children inherit, and tools that interpreters run: batch, stream, and a plain walk in Python."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from emberwatch.functions import rules as R
from emberwatch.operators import asof as J
from emberwatch.plans import inventory_queries as IQ
from emberwatch.streaming import jobs as S

T0 = 1_704_067_200_000
NAMES = [f.split()[0] for f in S.EVENT.split(", ")]
HARMLESS, SUSPICIOUS = ["/opt/a", "/opt/b", "/srv/c"], ["/tmp/nc", "/dev/shm/x"]


def events(spark, rows):
    full = [{"asset_id": "h", "event_id": k} | r | {"ts": T0 + r["ts"]} for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in full], S.EVENT)


def ran(ts, pid, image, ppid=None, **more):
    return {"kind": "ProcessExec", "ts": ts, "pid": pid, "ppid": ppid, "image": image} | more


def connects(ts, pid, image="", daddr="203.0.113.7", dport=4444):
    return {"kind": "NetConnect", "ts": ts, "pid": pid, "image": image, "daddr": daddr, "dport": dport}


def writes(ts, pid, image="", path="/etc/cron.d/job"):
    return {"kind": "FileWrite", "ts": ts, "pid": pid, "image": image, "path": path}


def test_chain_of_a_grandchild_fires(spark):
    below = [ran(10, 2, "/opt/a", 1), ran(20, 3, "/opt/b", 2), writes(30, 3, "b"), connects(40, 3, "b")]
    got = J.correlated(events(spark, [ran(0, 1, "/tmp/nc"), *below]))
    assert [(r["rule"], r["inherited"], r["process"]) for r in got.orderBy("event_id").collect()] == [
        ("suspicious_process_suspicious_file_write", True, "/opt/b"), ("suspicious_process_suspicious_connection", True, "/opt/b"),
    ]
    assert [r["rule"] for r in J.chains(got).collect()] == ["suspicious_process_wrote_file_and_connected"]
    alone = J.correlated(events(spark, [ran(0, 1, "/opt/c"), *below]))
    assert alone.where("rule IS NOT NULL OR inherited").isEmpty() and J.chains(alone).isEmpty()


@pytest.mark.parametrize(
    ("rows", "inherits"),
    [
        ([ran(0, 1, "/tmp/nc"), {"kind": "ProcessExit", "ts": 5, "pid": 1}, ran(5004, 2, "/opt/a", 1)], True),  # just exited
        ([ran(0, 1, "/tmp/nc"), {"kind": "ProcessExit", "ts": 5, "pid": 1}, ran(5005, 2, "/opt/a", 1)], False),
        ([ran(0, 1, "/tmp/nc"), ran(5, 1, "/opt/b"), ran(6, 2, "/opt/a", 1)], False),  # the pid is another process now
        ([ran(0, 2, "/tmp/nc"), ran(5, 2, "/opt/a", 2)], False),  # its own parent
        ([ran(9, 1, "/tmp/nc"), ran(5, 2, "/opt/a", 1)], False),  # not yet
        ([ran(0, 1, "/tmp/nc", asset_id="other"), ran(5, 2, "/opt/a", 1)], False),
    ],
)
def test_who_is_a_parent(spark, rows, inherits):
    got = J.correlated(events(spark, [*rows, connects(5100, 2, "a")])).where("asset_id = 'h'").collect()
    assert [(r["process"], r["inherited"], r["rule"] is not None) for r in got] == [("/opt/a", inherits, inherits)]


def test_another_instance_inherits_nothing(spark):
    rows = [ran(0, 1, "/tmp/nc"), ran(10, 2, "/opt/a", 1), connects(20, 2, "other"), connects(21, 2, "base64")]
    got = J.correlated(events(spark, rows)).orderBy("event_id").collect()
    assert [(r["process"], r["inherited"], r["process_severity"]) for r in got] == [("other", False, 1), ("base64", False, 3)]


def random_events(rng, n):
    rows, ts = [], 0
    for _ in range(n):
        ts += rng.choice([0, 1, 40, 120, 300, 2500])
        pid = rng.randint(1, 7)
        kind = rng.choice(["ProcessExec", "ProcessExec", "ProcessExit", "NetConnect", "FileWrite", "FileOpen"])
        rows.append({
            "kind": kind, "ts": ts, "pid": pid, "ppid": rng.choice([None, *range(1, 8)]), "asset_id": rng.choice(["h", "i"]),
            "image": rng.choice(HARMLESS * 2 + SUSPICIOUS) if kind == "ProcessExec" else rng.choice(["", "a", "nc", "base64"]),
            "daddr": rng.choice(["203.0.113.7", "10.0.0.1"]), "dport": rng.choice([4444, 443]), "path": rng.choice(["/etc/cron.d/job", "/etc/shadow", "/tmp/x"]),
        })
    return rows


def walked(spark, rows):
    """(event_id: severity of its process) by a walk over the events in order."""
    images = {i: r for i, r in zip(HARMLESS + SUSPICIOUS, spark.createDataFrame([(i,) for i in HARMLESS + SUSPICIOUS], "image string").select(R.image_severity(F.col("image"))).collect(), strict=True)}
    live, out = {}, {}
    for k, r in sorted(enumerate(rows), key=lambda x: (x[1]["ts"], x[0])):
        at = (r["asset_id"], r["pid"])
        if r["kind"] == "ProcessExec":
            up = live.get((r["asset_id"], r["ppid"])) if r["ppid"] != r["pid"] else None
            above = up["sev"] if up and not (up["left"] is not None and r["ts"] - up["left"] >= 5000) else 1
            live[at] = {"sev": max(images[r["image"]][0], above), "left": None}
            out[k] = live[at]["sev"]
        elif r["kind"] == "ProcessExit" and at in live:
            live[at]["left"] = r["ts"]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_batch_and_walk_agree(spark, seed):
    rng = random.Random(seed)
    rows = random_events(rng, 260)
    e = events(spark, rows)
    effective = {r["event_id"]: r["effective"] for r in J.ancestry(e).collect()}
    assert effective == walked(spark, rows)
    batch = J.correlated(e)
    cols = ["event_id", "process", "exec_id", "process_severity", "inherited", "event_severity", "rule", "severity_id"]
    folder = tempfile.mkdtemp(prefix="spark-")
    # Three files, each a little out of order against the next, and one that moves the watermark on.
    last = max(r["ts"] for r in rows)
    part = e.withColumn("part", F.floor((F.col("ts") - T0 + F.pmod(F.xxhash64("event_id"), F.lit(4000))) * 3 / (last + 4001)))
    for k in range(3):
        part.where(F.col("part") == k).select(*NAMES).coalesce(1).write.parquet(f"{folder}/in/{k}")
    events(spark, [{"kind": "ProcessExit", "ts": last + 10**8, "pid": -1, "asset_id": "~"}]).coalesce(1).write.parquet(f"{folder}/in/z")
    stream = spark.readStream.schema(S.EVENT).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    try:
        out = S.correlation_stream(S.with_event_time(stream, "ts", "10 seconds"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(S.CORRELATED).parquet(f"{folder}/out")
    order = lambda df: sorted([tuple(r) for r in df.collect()], key=str)
    assert order(got.where("record = 'event'").select(*cols)) == order(batch.select(*cols))
    chain = ["asset_id", "pid", "exec_id", "ts", "first_id", "connect_id", "rule"]
    assert order(got.where("record = 'chain'").select(*chain)) == order(J.chains(batch).select(*chain))
    assert not batch.where("inherited AND rule IS NOT NULL").isEmpty()


def test_tool_counts_for_its_interpreter_alone(spark):
    rows = [
        ran(0, 1, "/usr/bin/node", cmdline="node /x/claude.js"), connects(1, 1, "curl"), connects(2, 1, "node"), connects(3, 1, "python3.12"), connects(4, 1, "cursor"),
        connects(5, 1, "node", daddr="not-an-ip"), connects(6, 2, "node"), {"kind": "ProcessExit", "ts": 7, "pid": 1}, connects(8, 1, "node"),
    ]
    got = IQ.ai_egress_records(events(spark, rows)).orderBy("event_id").collect()
    assert [(r["event_id"], r["tool"], r["via"]) for r in got] == [(2, "claude-code", "cmdline"), (3, "claude-code", "cmdline"), (4, "cursor", "comm")]
