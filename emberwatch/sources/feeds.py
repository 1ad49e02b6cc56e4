"""Readers of event files, advisory bundles, score feeds and state. All schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.operators.vulnerabilities import EVENTS

ENVELOPE = "class_uid int, class_name string, time bigint, severity_id smallint, metadata struct<product:string,version:string,tenant_id:string>, device struct<hostname:string,os:string,os_version:string>, data string"
_REQUIRED = ["class_uid", "class_name", "time", "severity_id", "metadata.product", "metadata.version", "metadata.tenant_id", "device.hostname", "device.os", "device.os_version", "data"]
EPSS_HEADER = "cve,epss,percentile"
SNAPSHOTS = ["os_version", "packages", "files", "listeners", "ai_runtimes", "ai_models", "network_hosts", "sshd_config", "login_defs"]


def _read(text: str) -> tuple[Column, Column]:
    """(the envelope `e` of a line as a generator, whether it is whole). A generator's column is worked out once a line: a
    filter or a field of it doesn't bring the parse along, as it does with a column of a projection."""
    fine = F.col("e").isNotNull()
    for c in _REQUIRED:
        fine = fine & F.col(f"e.{c}").isNotNull()
    return F.explode(F.array(F.when(F.trim(F.col(text)) != "", F.from_json(text, ENVELOPE)))).alias("e"), fine


def parse_envelopes(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(envelopes, rejected lines) of NDJSON lines. Blank lines are neither; a line is rejected that doesn't parse or
    lacks a field. `data` stays raw JSON. Works on streams as well."""
    e, fine = _read(text)
    p = lines.select(text, e)
    return p.where(fine).select("e.*"), p.where((F.trim(F.col(text)) != "") & ~fine).select(F.col(text).alias("line"))


def observed_envelopes(lines: DataFrame, text: str = "value") -> tuple[DataFrame, Observation]:
    """(envelopes, counts) of NDJSON lines: `n_lines`, `n_blank` and `n_skipped` (rejected) are counted by the scan that reads
    the envelopes, and are there when an action over these has run."""
    seen, blank, (e, fine) = Observation(), F.trim(F.col(text)) == "", _read(text)
    p = lines.select(text, e).withColumn("fine", ~blank & fine)
    p = p.observe(seen, F.count("*").alias("n_lines"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & ~F.col("fine")).alias("n_skipped"))
    return p.where("fine").select("e.*"), seen


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_envelopes(spark.read.text(path))


def of_class(envelopes: DataFrame, class_uid: int) -> DataFrame:
    return envelopes.where(F.col("class_uid") == class_uid)


def lenient(json_array: Column, element: str, required: list[str]) -> Column:
    """Well-formed elements of a JSON array; what is no array is empty. Each element is parsed by itself, so a bad one
    doesn't take its siblings along. Strings of the schema must be JSON strings."""
    items = F.from_json(json_array, "array<string>")
    parsed = F.transform(items, lambda x: F.from_json(x, element))
    fine = lambda e: [e[c].isNotNull() for c in required]

    def keep(e: Column) -> Column:
        out = e.isNotNull()
        for f in fine(e):
            out = out & f
        return out

    return F.coalesce(F.filter(parsed, keep), F.array().cast(f"array<struct<{element.replace(' ', ':')}>>"))


def detections(data: Column, path: str = "$.detections") -> Column:
    return lenient(F.get_json_object(data, path), "rule string, reason string".replace(", ", ","), ["rule"])


def read_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name not in SNAPSHOTS:
        raise ValueError(f"unknown snapshot table {name}")
    return spark.read.parquet(f"{folder}/{name}")


def read_osv(spark: SparkSession, path: str) -> DataFrame:
    """Advisories of a bundle (a JSON array, or a folder of such), a row for each affected clause. Bad input fails."""
    clause = f"array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:{EVENTS}>>,versions:array<string>>>"
    docs = spark.read.schema(f"id string, affected {clause}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    if docs.isEmpty():
        raise ValueError(f"no advisory in {path}")
    a = docs.select("id", F.explode("affected").alias("a"))
    return a.select("id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), F.coalesce("a.versions", F.array().cast("array<string>")).alias("versions"), F.coalesce("a.ranges", F.array().cast(f"array<struct<type:string,events:{EVENTS}>>")).alias("ranges"))


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    """Windows advisories, wrapped with a tier and a date or as a bare array; aliases in lower case, tier `community` if
    unknown."""
    record = f"struct<id:string,affected_windows:array<struct<product:string,aliases:array<string>,ranges:{EVENTS}>>>"
    t = spark.read.text(path, wholetext=True)
    w = F.from_json("value", f"feed_tier string, snapshot_date string, records array<{record}>")
    t = t.select(w.alias("w"), F.from_json("value", f"array<{record}>").alias("bare"))
    t = t.select(F.coalesce(F.when(F.size("w.records") >= 0, F.col("w.records")), F.col("bare")).alias("r"), F.col("w.feed_tier").alias("tier"), "w.snapshot_date")
    t = t.withColumn("r", F.coalesce("r", F.raise_error(F.lit("a bundle without records")).cast(f"array<{record}>")))
    a = t.select(F.explode("r").alias("r"), "tier", "snapshot_date").select("r.id", F.explode("r.affected_windows").alias("a"), "tier", "snapshot_date")
    tier = F.when(F.col("tier").isin("community", "licensed", "commercial"), F.col("tier")).otherwise("community")
    return a.select("id", "a.product", F.transform("a.aliases", F.lower).alias("aliases"), F.col("a.ranges").alias("ranges"), tier.alias("tier"), "snapshot_date")


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """(vuln_id, epss, percentile) of CSV lines. Blank lines, comments and the header (a whole line) are skipped wherever
    they stand; a line of fewer columns or without numbers fails; the last line of a vulnerability counts. A file is read as one text,
    since its lines have an order; score feeds have some ten megabytes."""
    l = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    l = l.where("line <> '' AND NOT startswith(line, '#')").where(F.lower("line") != EPSS_HEADER).withColumn("c", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    value = lambda k: F.get("c", k).try_cast("double")
    bad = value(1).isNull() | value(2).isNull()
    name = F.when(bad, F.raise_error(F.concat(F.lit("not a score line: "), F.col("line"))).cast("string")).otherwise(F.get("c", 0))
    r = l.select(name.alias("vuln_id"), F.struct("n", value(1).alias("epss"), value(2).alias("percentile")).alias("v"))
    return r.groupBy("vuln_id").agg(F.max("v").alias("v")).select("vuln_id", F.col("v.epss").cast("float").alias("epss"), F.col("v.percentile").cast("float").alias("percentile"))


def read_kev(spark: SparkSession, path: str) -> DataFrame:
    k = spark.read.schema("vulnerabilities array<struct<cveID:string>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return k.select(F.explode("vulnerabilities.cveID").alias("vuln_id")).where("vuln_id IS NOT NULL").distinct()


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Raw advisories of a bundle for cvss_evidence(): id, score, severity, maturity, and their order of reading. Bundles
    are arrays, or objects whose `records` are; files count in the order of their names."""
    record = "id:string,severity:array<struct<type:string,score:string>>,database_specific:struct<cvss_base_score:double,exploit_maturity:string>"
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    wrapped, bare = F.from_json("value", f"records array<struct<{record}>>")["records"], F.from_json("value", f"array<struct<{record}>>")
    r = t.select("file", F.posexplode(F.coalesce(F.when(F.size(wrapped) >= 0, wrapped), bare, F.raise_error(F.lit("a bundle without records")).cast(f"array<struct<{record}>>"))).alias("n", "r"))
    return r.select("r.id", F.col("r.database_specific.cvss_base_score").alias("score"), "r.severity", F.col("r.database_specific.exploit_maturity").alias("maturity"), F.struct("file", "n").alias("seq"))


def cvss_evidence(osv_json: DataFrame | None, nvd_json: DataFrame | None) -> DataFrame:
    """(vuln_id, cvss_env, vector, maturity) of raw advisories (seq, id, score, severity array<struct<type,score>>,
    maturity): the first CVSS_V3 vector that isn't empty; the last record of an id counts, and Windows advisories count
    more than others."""
    known = ["none", "poc", "functional", "weaponized", "in_the_wild"]
    parts = [d.withColumn("rank", F.lit(k)) for k, d in enumerate((osv_json, nvd_json)) if d is not None]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    vector = F.get(F.filter("severity", lambda s: (F.upper(s["type"]) == "CVSS_V3") & (s["score"] != "")), 0)["score"]
    m = F.col("maturity")  # as it is written; another spelling is unknown
    r = both.select(F.col("id").alias("vuln_id"), F.struct(F.col("score").cast("float").alias("cvss_env"), vector.alias("vector"), F.when(m.isin(known), m).otherwise("none").alias("maturity")).alias("v"), F.struct("rank", "seq").alias("o"))
    return r.groupBy("vuln_id").agg(F.max_by("v", "o").alias("v")).select("vuln_id", "v.*")


def feed_violations(spark: SparkSession, folder: str, manifest: DataFrame, most_files: int = 1024, most_bytes: int = 256 << 20) -> DataFrame:
    """Files of a feed against its manifest (name, sha256): missing, unlisted, changed, too large, repeated or oddly named
    ones (empty, `.`, `..`, or with a separator). Digests are made by the tasks that read the files."""
    f = spark.read.format("binaryFile").load(folder).select(F.substring_index("path", "/", -1).alias("name"), "length", F.sha2("content", 256).alias("actual"))
    m = manifest.groupBy("name").agg(F.first("sha256").alias("sha256"), F.count("*").alias("n"))
    total = manifest.select(F.count("*").alias("entries"))
    j = m.join(f, "name", "full_outer").join(F.broadcast(total))
    checks = [
        (F.col("sha256").isNull(), "unlisted"), (F.col("actual").isNull(), "missing"), (F.lower(F.btrim("sha256", F.lit(" \t\r\n\x0b\x0c"))) != F.col("actual"), "changed"),
        (F.col("length") > most_bytes, "too_large"), (F.col("n") > 1, "repeated"), (F.col("name").rlike(r"\A(|\.|\.\.)\z|[/\\\x00]"), "bad_name"), (F.col("entries") > most_files, "too_many"),
    ]
    return j.select("name", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in checks]))).alias("violation"))


def staleness_ms(created_at: Column, now: Column) -> Column:
    return F.greatest(now - created_at, F.lit(0))


def installed_feed(spark: SparkSession, root: str) -> DataFrame:
    """The active snapshot's state of a feed store, one row: feed_version, source, tier, created_at, applied_at. A store
    without one is an error."""
    state = spark.read.schema("feed_version string, source string, tier string, created_at long, applied_at long").option("multiLine", True).option("mode", "FAILFAST").json(f"{root}/state.json")
    if state.isEmpty():
        raise ValueError(f"{root} has no installed feed")
    return state


def stamped(rows: DataFrame, feed_version: str | None) -> DataFrame:
    if feed_version is None:
        raise ValueError("no feed is installed")
    return rows.withColumn("feed_version", F.lit(feed_version))


def declared_cases(cases: DataFrame) -> DataFrame:
    """Cases with their defaults; a repeated id fails."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    c = cases.withColumn("_n", n).withColumn("case_id", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("repeated case "), F.col("case_id"))).cast("string")).otherwise(F.col("case_id"))).drop("_n")
    return c.na.fill({"platform": "linux", "tier": "A", "expected_result": "hit", "seconds": 5.0})


def read_captures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(case records, idle baseline): case_id, trigger and the raw record; the record alone."""
    d = spark.read.schema("agent string, run_id string, cases array<struct<case_id:string,trigger_time:bigint,records:array<string>>>, baseline array<string>").option("multiLine", True).json(path)
    c = d.select("agent", "run_id", F.explode("cases").alias("c")).select("agent", "run_id", "c.case_id", F.col("c.trigger_time").alias("trigger"), F.explode_outer("c.records").alias("record"))
    return c, d.select("agent", F.explode("baseline").alias("record"))


def rules_at_any_depth(record: Column) -> Column:
    """All `rule` strings under a raw record's `data`, however deep, sorted. In JSON a quoted name with a colon behind it
    is a field, as quotes within strings are escaped."""
    found = F.regexp_extract_all(F.get_json_object(record, "$.data"), F.lit(r'"rule"\s*:\s*("(?:[^"\\]|\\.)*")'), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.from_json(F.concat(F.lit('{"v":'), x, F.lit("}")), "v string")["v"])))


def rules_of(record: Column) -> Column:
    """Rules of a raw record, wherever a detection stands: at the top, or with its process, connection or file."""
    parts = [F.transform(detections(record, f"$.data.{p}detections"), lambda d: d["rule"]) for p in ("", "process.", "connection.", "file.")]
    return F.array_distinct(F.concat(*parts))
