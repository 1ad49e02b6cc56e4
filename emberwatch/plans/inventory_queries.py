"""Queries over AI usage, inventory text and health, on text and events that are derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.fixtures import SENSOR_EVENTS, sensor_events, table
from emberwatch.functions import ai as A
from emberwatch.functions import rules as R
from emberwatch.operators import posture as P
from emberwatch.plans import sqltext as Q
from emberwatch.sources import inventory as I

_E = f"WITH {SENSOR_EVENTS}"
_IMAGES = ["/usr/bin/node", "/usr/bin/python3.12", "/opt/cursor", "/usr/bin/github-copilot-", "C:\\bin\\Claude.exe", "/usr/bin/bash"]
_CMDS = ["node /x/claude.js -p", "python3 -m aider", "cursor .", "x", "claude.exe", "bash -c ls"]


def ai_egress_records(events: DataFrame) -> DataFrame:
    """Connections of AI tools: by the connecting image, or, where that is an interpreter, by the command line of the
    interpreter that runs as that process (the last exec decides; an exit clears it). One window over a process's rows."""
    w = Window.partitionBy("asset_id", "pid").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    tool = F.when(A.is_interpreter(F.col("image")), A.tool_in_cmdline(F.col("cmdline")))
    mark = F.when(F.col("kind") == "ProcessExec", F.struct(tool.alias("tool"))).when(F.col("kind") == "ProcessExit", F.struct(F.lit(None).cast("string").alias("tool")))
    e = events.where(F.col("kind").isin("ProcessExec", "ProcessExit", "NetConnect")).withColumn("mark", mark)
    e = e.withColumn("running", F.last("mark", True).over(w)["tool"]).where("kind = 'NetConnect'")
    own = A.tool_of(F.col("image"))
    running = F.when(A.is_interpreter(F.col("image")), F.col("running"))
    e = e.withColumns({"tool": F.coalesce(own, running), "via": F.when(own.isNotNull(), "comm").otherwise("cmdline"), "scope": R.connection_scope(F.col("daddr"))})
    return e.where("tool IS NOT NULL AND scope IS NOT NULL").withColumn("record", F.when(F.col("scope") == "external", "ai_tool_egress").otherwise("ai_tool_local"))


def ai_images(events: DataFrame) -> DataFrame:
    """Events with images and command lines of AI tools. A third of the connections are by an interpreter, and a third by
    another image, which gets no tool even where the process runs one."""
    pick = lambda v, n: F.get(F.array(*[F.lit(x) for x in v]), (F.col("k") % n).cast("int"))
    return events.withColumns({"image": F.when(F.col("kind") == "NetConnect", F.when(F.col("event_id") % 3 == 0, pick(_IMAGES, 6)).when(F.col("event_id") % 3 == 1, "node").otherwise("/usr/bin/curl")).otherwise(pick(_IMAGES, 6)), "cmdline": pick(_CMDS, 6)})


def ai_egress(spark: SparkSession, sf: str) -> DataFrame:
    e = ai_images(sensor_events(spark, sf))
    return ai_egress_records(e).groupBy("tool", "via", "scope", "record").agg(F.count("*").alias("connections"), F.countDistinct("asset_id").alias("hosts"))


_AI = f"""{_E}, e AS (SELECT event_id, asset_id, pid, ts, kind, daddr, k % 6 AS i, event_id % 3 = 0 AS own, event_id % 3 = 1 OR (event_id % 3 = 0 AND k % 6 IN (0, 1)) AS interpreter FROM sensor_events WHERE kind IN ('ProcessExec', 'ProcessExit', 'NetConnect')),
m AS (SELECT *, CASE kind WHEN 'ProcessExec' THEN CASE i WHEN 0 THEN 'claude-code' WHEN 1 THEN 'aider' ELSE '' END WHEN 'ProcessExit' THEN '' END AS mark FROM e),
r AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY asset_id, pid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_mark FROM m),
n AS (SELECT *, CASE WHEN interpreter THEN last_mark END AS running FROM r),
t AS (SELECT *, CASE WHEN own THEN CASE i WHEN 2 THEN 'cursor' WHEN 3 THEN 'github-copilot' WHEN 4 THEN 'claude-code' END END AS mine, CASE WHEN starts_with(daddr, '127.') THEN 'loopback' WHEN {Q.EXTERNAL} THEN 'external' WHEN daddr <> 'not-an-ip' THEN 'private' END AS scope FROM n WHERE kind = 'NetConnect')
SELECT coalesce(mine, running) AS tool, CASE WHEN mine IS NOT NULL THEN 'comm' ELSE 'cmdline' END AS via, scope, CASE WHEN scope = 'external' THEN 'ai_tool_egress' ELSE 'ai_tool_local' END AS record, count(*) AS connections, count(DISTINCT asset_id) AS hosts
FROM t WHERE coalesce(mine, running, '') <> '' AND scope IS NOT NULL GROUP BY 1, 2, 3, 4"""


def _host(spark, sf):
    s = table(spark, sf, "supplier")
    return s.withColumn("asset_id", F.concat(F.lit("sup-"), F.col("s_suppkey").cast("string")))


def listeners(spark, sf):
    s = _host(spark, sf)
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    ss = s.where("s_suppkey % 3 = 0").select("asset_id", F.concat(F.lit("State Recv-Q Send-Q Local\nLISTEN 0 128 [::1]:"), n, F.lit(' *:* users:(("ollama",pid='), k, F.lit(",fd=3))\nLISTEN 0 5 *:8"), n, F.lit(" *:*\nESTAB 0 0 1.2.3.4:5 6.7.8.9:1\n")).alias("text"))
    ns = s.where("s_suppkey % 3 = 1").select("asset_id", F.concat(F.lit("  Proto Local\r\n  TCP  0.0.0.0:1337  0.0.0.0:0  LISTENING  "), k, F.lit("\r\n  TCP  1.2.3.4:9  0.0.0.0:0  ESTABLISHED 4\r\n")).alias("text"))
    lo = s.where("s_suppkey % 3 = 2").select("asset_id", F.concat(F.lit("vllm "), k, F.lit(" root 5u IPv4 0x0 0t0 TCP 127.0.0.1:8000 (LISTEN)\nbad line\n")).alias("text"))
    tasks = s.where("s_suppkey % 2 = 1").select("asset_id", F.concat(F.lit('"LM-Studio.exe","'), k, F.lit('","Console","1"')).alias("text"))
    l = I.ss_listeners(ss).unionByName(I.resolve_processes(I.netstat_listeners(ns), tasks)).unionByName(I.lsof_listeners(lo))
    run = A.runtime_of(F.col("process"), F.col("port"))
    return l.select("asset_id", "local_addr", F.col("port").cast("long").alias("port"), "pid", "process", run.alias("runtime"), F.when(run.isNotNull(), A.is_exposed(F.col("local_addr"))).alias("exposed"))


_LISTEN = """SELECT 'sup-' || s_suppkey AS asset_id, local_addr, CAST(port AS BIGINT) AS port, CAST(pid AS BIGINT) AS pid, process, runtime, exposed FROM (
SELECT s_suppkey, '::1' AS local_addr, s_nationkey AS port, s_suppkey AS pid, 'ollama' AS process, 'Ollama' AS runtime, false AS exposed FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, '0.0.0.0', CAST('8' || s_nationkey AS INT), NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT s_suppkey, '0.0.0.0', 1337, s_suppkey, CASE WHEN s_suppkey % 2 = 1 THEN 'LM-Studio' END, CASE WHEN s_suppkey % 2 = 1 THEN 'LM Studio' ELSE 'Jan' END, true FROM supplier WHERE s_suppkey % 3 = 1
UNION ALL SELECT s_suppkey, '127.0.0.1', 8000, s_suppkey, 'vllm', 'vLLM', false FROM supplier WHERE s_suppkey % 3 = 2) x"""


def ai_servers(spark, sf):
    l = listeners(spark, sf).where("runtime IS NOT NULL")
    return l.groupBy("asset_id").agg(F.count("*").alias("servers"), F.count_if("exposed").alias("exposed"))


def ai_models(spark, sf):
    p = table(spark, sf, "part")
    ext = F.get(F.array(*[F.lit(x) for x in ("gguf", "pt", "bin", "txt", "PKL", "h5")]), (F.col("p_partkey") % 6).cast("int"))
    m = p.select(F.concat(F.lit("host-"), (F.col("p_size") % 10).cast("string")).alias("asset_id"), A.model_format(F.concat(F.lit("/models/m."), ext)).alias("m")).where("m IS NOT NULL")
    return m.groupBy("asset_id", F.col("m.format").alias("format")).agg(F.count("*").alias("models"), F.count_if("m.risky").alias("risky"))


def packages(spark, sf):
    s = _host(spark, sf)
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    dpkg = s.where("s_suppkey % 4 = 0").select("asset_id", F.concat(F.lit("Package: a"), n, F.lit("\nStatus: install ok installed\nVersion: 1."), k, F.lit("\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 2\n")).alias("text"))
    rpm = s.where("s_suppkey % 4 = 1").select("asset_id", F.concat(F.lit("b"), n, F.lit("\t2."), k, F.lit("-1.el8\nno tab\n")).alias("text"))
    brew = s.where("s_suppkey % 4 = 2").select("asset_id", F.concat(F.lit("c"), n, F.lit(" 3."), k, F.lit(" 2.9\nlonely\n")).alias("text"))
    reg = s.where("s_suppkey % 4 = 3").select("asset_id", F.concat(F.lit("HKEY_LOCAL\\A\r\n    DisplayName    REG_SZ    D "), n, F.lit("\r\n    DisplayVersion    REG_SZ    4."), k, F.lit("\r\n\r\nHKEY_LOCAL\\B\r\n    DisplayNameX    REG_SZ    no\r\n")).alias("text"))
    return I.dpkg_packages(dpkg).unionByName(I.rpm_packages(rpm)).unionByName(I.brew_packages(brew)).unionByName(I.registry_packages(reg))


_PACK = """SELECT 'sup-' || s_suppkey AS asset_id, CASE s_suppkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'D ' END || s_nationkey AS name,
CASE s_suppkey % 4 WHEN 0 THEN '1.' WHEN 1 THEN '2.' WHEN 2 THEN '3.' ELSE '4.' END || s_suppkey || CASE WHEN s_suppkey % 4 = 1 THEN '-1.el8' ELSE '' END AS version,
CASE s_suppkey % 4 WHEN 0 THEN 'dpkg' WHEN 1 THEN 'rpm' WHEN 2 THEN 'brew' ELSE 'registry' END AS source FROM supplier"""


def network_blocks(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("10."), (F.col("c_custkey") % 256).cast("string"), F.lit(".3.77/"), (F.lit(20) + F.col("c_custkey") % 14).cast("string")).alias("cidr"))
    x = c.select("c_custkey", I.expand_cidr(F.col("cidr"), 256).alias("a"))
    return x.select("c_custkey", F.size("a").cast("long").alias("addresses"), F.get("a", 0).alias("first"), F.when(F.size("a") > 0, F.element_at("a", -1)).alias("last"))


_BLOCKS = """WITH c AS (SELECT c_custkey, c_custkey % 256 AS b, 20 + c_custkey % 14 AS p FROM customer), d AS (SELECT *, CASE WHEN p BETWEEN 24 AND 32 THEN CAST(pow(2, 32 - p) AS BIGINT) ELSE 0 END AS n FROM c)
SELECT c_custkey, n AS addresses, CASE WHEN n > 0 THEN '10.' || b || '.3.' || (77 - 77 % n) END AS first, CASE WHEN n > 0 THEN '10.' || b || '.3.' || (77 - 77 % n + n - 1) END AS last FROM d"""


def health(spark, sf):
    """Use of a budget; a budget of nothing shows as the greatest single-precision number."""
    o = table(spark, sf, "orders").select(F.concat(F.lit("host-"), (F.col("o_custkey") % 20).cast("string")).alias("asset_id"), (F.col("o_orderkey") % 9).cast("float").alias("cpu"), (F.col("o_orderkey") % 5).cast("float").alias("budget"))
    return P.health(o, F.col("cpu"), F.col("budget")).groupBy("asset_id").agg(F.count_if("over_budget").alias("over_budget"), F.count_if(F.col("budget") <= 0).alias("no_budget"), F.round(F.avg("cpu"), 6).alias("cpu"))


QUERIES = {"ai_egress": ai_egress, "listeners": listeners, "ai_servers": ai_servers, "ai_models": ai_models, "inventory_packages": packages, "network_blocks": network_blocks, "health_budget": health}
SQL = {
    "ai_egress": _AI,
    "listeners": _LISTEN,
    "ai_servers": f"SELECT asset_id, count(*) AS servers, count(*) FILTER (exposed) AS exposed FROM ({_LISTEN}) l WHERE runtime IS NOT NULL GROUP BY 1",
    "ai_models": "SELECT 'host-' || (p_size % 10) AS asset_id, ['gguf', 'pytorch', 'pytorch-bin', NULL, 'pickle', 'keras-h5'][1 + p_partkey % 6] AS format, count(*) AS models, count(*) FILTER (p_partkey % 6 IN (1, 2, 4)) AS risky FROM part WHERE p_partkey % 6 <> 3 GROUP BY 1, 2",
    "inventory_packages": _PACK,
    "network_blocks": _BLOCKS,
    "health_budget": "SELECT 'host-' || (o_custkey % 20) AS asset_id, count(*) FILTER (o_orderkey % 5 = 0 OR (o_orderkey % 9) > (o_orderkey % 5)) AS over_budget, count(*) FILTER (o_orderkey % 5 = 0) AS no_budget, round(avg(CAST(o_orderkey % 9 AS DOUBLE)), 6) AS cpu FROM orders GROUP BY 1",
}
