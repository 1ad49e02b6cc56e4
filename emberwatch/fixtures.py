"""Views that give the queries input of the engine's shape, from the star-schema tables; each also as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.sources.shared import dealt

IMAGES = ["/usr/bin/bash", "/tmp/nc", "/usr/bin/curl", "/usr/sbin/nginx", "/usr/bin/python3.12", "/dev/shm/payload", "/usr/bin/base64", "/opt/app/server"]
ADDRESSES = ["203.0.113.7", "10.0.0.5", "127.0.0.1", "2001:db8::1", "192.168.1.9", "not-an-ip"]
PORTS = [4444, 443, 9001, 53, 1337]
PATHS = ["/etc/cron.d/job", "/usr/bin/x", "/home/u/.ssh/id_rsa", "/tmp/a.txt", "/etc/shadow", "/var/log/app.log", "/usr/lib/libssl.so.3", "/etc/app.conf"]
PACKAGES, SOURCES, SYSTEMS = ["openssl", "curl", "sudo", "zlib", "glibc", "putty"], ["dpkg", "rpm", "registry"], ["Ubuntu", "Debian", ""]


def _pick(values: list, at) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _sql(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # `k` comes out of a generator, so it is parsed once a row and not wherever a filter looks at what is made from it.
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.explode(F.array(F.get_json_object("props", "$.k").cast("int"))).alias("k"))
    kind = F.when(F.col("event_type") == "signup", "ProcessExec").when(F.col("event_type") == "error", "ProcessExit").when(F.col("event_type") == "click", "NetConnect").when(F.col("event_type") == "purchase", "FileWrite").otherwise("FileOpen")
    return e.select(
        "event_id",
        F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")).alias("asset_id"),
        F.col("user_id").alias("pid"),
        F.when(F.col("user_id") >= 10, F.col("user_id") - 10).alias("ppid"),
        (F.lit(1704067200000) + F.col("event_id") * 40).alias("ts"),
        kind.alias("kind"),
        "k",
        _pick(IMAGES, F.col("k") % 8).alias("image"),
        _pick(ADDRESSES, F.col("k") % 6).alias("daddr"),
        _pick(PORTS, F.col("event_id") % 5).alias("dport"),
        _pick(PATHS, F.col("k") % 8).alias("path"),
    )


SENSOR_EVENTS = f"""sensor_events AS (
  SELECT event_id, 'host-' || (user_id % 10) AS asset_id, user_id AS pid, CASE WHEN user_id >= 10 THEN user_id - 10 END AS ppid,
         1704067200000 + event_id * 40 AS ts,
         CASE event_type WHEN 'signup' THEN 'ProcessExec' WHEN 'error' THEN 'ProcessExit' WHEN 'click' THEN 'NetConnect' WHEN 'purchase' THEN 'FileWrite' ELSE 'FileOpen' END AS kind,
         k, ({_sql(IMAGES)})[1 + k % 8] AS image, ({_sql(ADDRESSES)})[1 + k % 6] AS daddr, ({_sql(PORTS)})[1 + event_id % 5] AS dport, ({_sql(PATHS)})[1 + k % 8] AS path
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e)"""


def sbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct components of hosts. What tells them apart (the part's number by 6 and its size) is made distinct as numbers,
    before the texts, in one shuffle whose partitions follow the table's rows."""
    l = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 6).cast("int").alias("kind"), "p_size")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", _pick(SYSTEMS, F.col("s_nationkey") % 3).alias("os")).distinct()
    parts = l.join(p, l.l_partkey == p.p_partkey).select("l_suppkey", "kind", "p_size")
    j = dealt(parts, l.count(), "l_suppkey", "kind", "p_size").distinct().join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.select(
        F.concat(F.lit("sup-"), F.col("l_suppkey").cast("string")).alias("asset_id"),
        _pick(PACKAGES, F.col("kind")).alias("name"),
        F.concat(F.lit("3."), (F.col("p_size") % 10).cast("string"), F.lit("."), F.col("p_size").cast("string")).alias("version"),
        _pick(SOURCES, F.col("kind") % 3).alias("source"),
        "os",
    )


SBOM = f"""sbom AS (
  SELECT DISTINCT 'sup-' || l_suppkey AS asset_id, ({_sql(PACKAGES)})[1 + p_partkey % 6] AS name,
         '3.' || (p_size % 10) || '.' || p_size AS version, ({_sql(SOURCES)})[1 + p_partkey % 3] AS source, ({_sql(SYSTEMS)})[1 + s_nationkey % 3] AS os
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
