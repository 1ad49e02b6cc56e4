"""Records of all classes in one pass, loads and inventories in any order, and slices of fixes."""

import json
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import findings as O
from emberwatch.operators import records as C
from emberwatch.sources import feeds, sinks
from emberwatch.streaming import jobs as S


def line(uid, data, host="h", time=5):
    return json.dumps({"class_uid": uid, "class_name": "x", "time": time, "severity_id": 1, "metadata": {"product": "p", "version": "1", "tenant_id": "t"}, "device": {"hostname": host, "os": "l", "os_version": ""}, "data": data})


LINES = [
    line(1007, {"process": {"image": "/tmp/nc"}, "detections": [{"rule": "lolbin", "reason": "r"}, {"bad": 1}, 7]}),
    line(1007, {"detections": [{"rule": "odd"}]}), line(1007, {"process": {"image": "/bin/x"}, "detections": []}), line(1007, {"process": "text", "detections": "none"}),
    line(4001, {"connection": {"daddr": "1.2.3.4", "dport": 65536 + 443}, "detections": [{"rule": "suspicious_port"}]}), line(4001, {"connection": {"daddr": "1.2.3.4"}, "detections": [{"rule": "suspicious_port"}]}),
    line(1001, {"file": {"path": "/etc/x"}, "detections": [{"rule": "write_to_system_dir"}]}),
    line(9002, {"process": {"image": "a->b"}, "connection": {"daddr": "::1", "dport": 1}, "detections": [{"rule": "suspicious_process_suspicious_connection"}]}),
    line(2003, {"compliance": {"records": [{"control_id": "c", "passed": False, "weight": 0.5, "subject": "s", "location": "l", "remediation_key": "k"}, {"control_id": "d", "passed": True, "weight": 0.5, "subject": "s", "location": "l", "remediation_key": "k"}, {"control_id": "e"}]}}),
    line(2004, {"fim": {"records": [{"entry_id": "f", "violated": True, "path": "/p", "weight": 0.5, "remediation_key": "k"}]}}),
    line(9001, {"detections": [{"rule": "x"}]}), "", "  ", '{"class_uid": 1007', line("1007", {}),
]


def test_all_classes_in_one_pass(spark):
    good, skipped = feeds.observed_envelopes(spark.createDataFrame([(x,) for x in LINES], "value string"))
    found = C.all_class_findings(good)
    assert sorted(r["finding_id"] for r in found.collect()) == sorted([
        "h|process:/tmp/nc|/tmp/nc|process", "h|process:||process", "h|network:1.2.3.4:443|1.2.3.4|network", "h|file:/etc/x|/etc/x|/etc/x",
        "h|correlation:a->b->::1:1|a|correlation", "h|c|s|l", "h|f|/p|filesystem",
    ])
    assert skipped.get == {"n_lines": len(LINES), "n_blank": 2, "n_skipped": 2}


def test_one_scan_and_one_parse(spark, tmp_path):
    (tmp_path / "e").write_text("\n".join(LINES))
    good, _ = feeds.observed_envelopes(spark.read.text(str(tmp_path / "e")))
    plan = C.all_class_findings(good)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[|RelationV2|LogicalRDD", plan)) == 1
    # The line once, its data once; the rest are elements of lists.
    whole = [p for p in re.findall(r"from_json\(([^,]*)", plan) if "StructField" in p]
    assert len([p for p in whole if "process" in p]) == 1


def test_loads_and_tools_are_records(spark):
    loads = spark.createDataFrame([("h", "/l.so", 5, "/bin/x")], "asset_id string, path string, pid long, image string")
    assert json.loads(C.load_envelopes(loads, F.lit(5)).first()["data"]) == {"module": {"path": "/l.so"}, "pid": 5, "image": "/bin/x"}
    use = spark.createDataFrame([("h", "ai_tool_egress", "external", "aider", "cmdline", 5, "python3", "1.2.3.4", 443)], "asset_id string, record string, scope string, tool string, via string, pid long, image string, daddr string, dport int")
    e = C.tool_envelopes(use, F.lit(5)).first()
    assert (e["class_uid"], json.loads(e["data"])) == (9004, {"kind": "ai_tool_egress", "scope": "external", "tool": "aider", "via": "cmdline", "process": {"pid": 5, "image": "python3"}, "connection": {"daddr": "1.2.3.4", "dport": 443}})


def test_blocks_of_correlated_records_have_their_own_detections(spark):
    from emberwatch.plans import detection as D
    from test_lineage import connects, events, ran

    rows = [ran(0, 1, "/tmp/nc"), ran(10, 2, "/opt/a", 1), connects(20, 2, "a")]
    e = C.activity_envelopes(D.correlation_records(events(spark, rows)), 9002, F.lit(4)).collect()
    assert len(e) == 1
    data = json.loads(e[0]["data"])
    rules = lambda block: [d["rule"] for d in block["detections"]]
    assert rules(data) == ["suspicious_process_suspicious_connection"]
    assert (rules(data["process"]), data["process"]["attributed"], data["process"]["pid"], data["process"]["image"]) == (["suspicious_ancestor"], True, 2, "/opt/a")
    assert (rules(data["connection"]), data["connection"]["dport"]) == (["suspicious_port", "suspicious_port_to_external"], 4444)


def mixed(rng):
    out = []
    for _ in range(60):
        host, path = f"h{rng.randint(0, 5)}", lambda: f"/l{rng.randint(0, 9)}"
        if rng.random() < 0.5 and host != "h0":
            out.append(line(9003, {"module": {"path": path()}}, host))
        else:
            out.append(line(5020, {"sbom": {"components": [{"name": f"p{rng.randint(0, 4)}", "libraries": [path() for _ in range(rng.randint(0, 2))]}, {"name": "", "libraries": ["/l1"]}, {"libraries": 3}]}}, host))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_reachability_of_a_stream(spark, seed):
    rows, folder = mixed(random.Random(seed)), tempfile.mkdtemp(prefix="spark-")
    batch = C.reachability_of(feeds.parse_envelopes(spark.createDataFrame([(x,) for x in rows], "value string"))[0])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    try:
        for k in range(3):
            spark.createDataFrame([(x,) for x in rows[k * 20 : k * 20 + 20]], "value string").write.mode("append").text(f"{folder}/in")
            out = S.reachability_stream(feeds.parse_envelopes(spark.readStream.text(f"{folder}/in"))[0])
            out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    told = spark.read.schema(S.REACHED).parquet(f"{folder}/out")
    assert told.groupBy("asset_id", "component", "runtime_reachable").count().where("count > 1").isEmpty()
    got = {(r[0], r[1]): r[2] for r in told.groupBy("asset_id", "component").agg(F.max("runtime_reachable")).collect()}
    want = {(r[0], r[1]): r[2] for r in batch.collect()}
    assert {k: v for k, v in got.items() if v is not None} == want and {k[0] for k, v in got.items() if v is None} == {"h0"} and True in want.values()


def test_slices_of_fixes(spark):
    n = 3000
    f = spark.range(n).select(F.concat(F.lit("h"), "id").alias("asset_id"), F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("vuln_id"), F.lit("fix").alias("remediation_key"), F.lit("open").alias("status"), F.lit(5).alias("risk"))
    s = O.fix_slices(f.unionByName(f), 100)
    got = s.where("kind = 'asset'").collect()
    assert len(got) == 30 and {(r["total"], r["slices"]) for r in got} == {(n, 30)} and max(len(r["members"]) for r in got) < 200
    assert sorted(m for r in got for m in r["members"]) == sorted(f"h{k}" for k in range(n))
    assert [(r["slice"], r["total"], len(r["members"])) for r in s.where("kind = 'closes'").collect()] == [(0, 7, 7)]
    assert O.fix_slices(f.limit(0)).isEmpty()


def test_sightings_are_told_once(spark, tmp_path):
    known = sinks.StateTable(spark, str(tmp_path / "k"), spark.createDataFrame([], S.SIGHTINGS), ("asset_id", "path"))
    loads = lambda: S.with_event_time(spark.readStream.schema(S.SIGHTINGS).parquet(str(tmp_path / "in")), "ts", "1 second")
    put = lambda *rows: spark.createDataFrame(list(rows), S.SIGHTINGS).write.mode("append").parquet(str(tmp_path / "in"))
    put(("h", "/a", 1000), ("h", "/a", 1500), ("i", "/a", 1000), ("h", None, 1))
    S.first_sightings_loop(loads(), known, str(tmp_path / "c1")).awaitTermination()
    put(("h", "/a", 999_000), ("h", "/b", 999_000))  # long after: the stream's own state has gone
    S.first_sightings_loop(loads(), known, str(tmp_path / "c1")).awaitTermination()
    segments = known.pointer()
    S.first_sightings_loop(loads(), known, str(tmp_path / "c2")).awaitTermination()  # another stream, from the start
    assert sorted(map(tuple, known.load().collect())) == [("h", "/a", 1000), ("h", "/b", 999_000), ("i", "/a", 1000)]
    assert known.pointer()["version"] > segments["version"]
