"""Fleet inventories out of collected text: rows (asset_id, collector, text) to packages, libraries and listeners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.rules import is_shared_library


def _lines(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("asset_id", F.posexplode(F.split(F.regexp_replace(text, "\r", ""), "\n")).alias("line_no", "line"))


def _field(paragraph: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(paragraph, rf"(?m)^{name}:[ \t]*(.*)$", 1))


def dpkg_packages(raw: DataFrame) -> DataFrame:
    """Paragraphs of a dpkg status file whose status ends with `installed`; a version may be blank."""
    p = raw.select("asset_id", F.explode(F.split(F.regexp_replace("text", "\r", ""), r"\n[ \t]*\n")).alias("p"))
    p = p.select("asset_id", _field(F.col("p"), "Package").alias("name"), _field(F.col("p"), "Version").alias("version"), _field(F.col("p"), "Status").alias("status"))
    return p.where((F.col("name") != "") & F.col("status").rlike(r"(^|\s)installed$")).select("asset_id", "name", "version", F.lit("dpkg").alias("source"))


def rpm_packages(raw: DataFrame) -> DataFrame:
    """Lines of name, tab, version."""
    l = _lines(raw).where(F.col("line").contains("\t"))
    part = lambda k: F.trim(F.split_part("line", F.lit("\t"), F.lit(k)))
    return l.select("asset_id", part(1).alias("name"), part(2).alias("version"), F.lit("rpm").alias("source")).where("name <> ''")


def rpm_libraries(raw: DataFrame) -> DataFrame:
    """Lines of name, tab, path: shared libraries by package."""
    l = _lines(raw).where(F.col("line").contains("\t"))
    l = l.select("asset_id", F.split_part("line", F.lit("\t"), F.lit(1)).alias("name"), F.trim(F.split_part("line", F.lit("\t"), F.lit(2))).alias("path"))
    return l.where(is_shared_library(F.col("path"), packaged=True)).groupBy("asset_id", "name").agg(F.array_sort(F.collect_set("path")).alias("libraries"))


def dpkg_libraries(raw: DataFrame) -> DataFrame:
    """Package file lists (asset_id, path of the list, text): the package is the list's name without `.list` and `:arch`."""
    name = F.regexp_replace(F.regexp_replace(F.substring_index("list_path", "/", -1), r"\.list$", ""), ":.*$", "")
    l = raw.select("asset_id", name.alias("name"), F.explode(F.split("text", "\r?\n")).alias("path"))
    return l.where(is_shared_library(F.col("path"), packaged=True)).groupBy("asset_id", "name").agg(F.array_sort(F.collect_set("path")).alias("libraries"))


def brew_packages(raw: DataFrame) -> DataFrame:
    """Name and first version of each line."""
    l = _lines(raw).select("asset_id", F.split(F.trim("line"), r"\s+").alias("w")).where((F.size("w") >= 2) & (F.get("w", 0) != ""))
    return l.select("asset_id", F.get("w", 0).alias("name"), F.get("w", 1).alias("version"), F.lit("brew").alias("source"))


def registry_packages(raw: DataFrame) -> DataFrame:
    """Blocks of an uninstall registry dump, each from an `HKEY_` line on; the last value of a name in a block counts."""

    def value(name: str) -> Column:
        found = F.regexp_extract_all("block", F.lit(rf"(?m)^[ \t]*{name}[ \t]+\S+[ \t]+(\S.*?)[ \t]*$"), F.lit(1))
        return F.when(F.size(found) > 0, F.element_at(found, -1))

    b = raw.select("asset_id", F.explode(F.split(F.regexp_replace("text", "\r", ""), r"(?m)(?=^[ \t]*HKEY_)")).alias("block"))
    b = b.select("asset_id", value("DisplayName").alias("name"), F.coalesce(value("DisplayVersion"), F.lit("")).alias("version"), F.lit("registry").alias("source"))
    return b.where(F.col("name").isNotNull())


def _address(text: Column) -> tuple[Column, Column]:
    """Address and port of `[v6]:port` or `addr:port`; a star is every address."""
    v6 = text.startswith("[")
    addr = F.when(v6, F.regexp_extract(text, r"^\[(.*?)\]:", 1)).otherwise(F.regexp_extract(text, r"^(.*):[^:]*$", 1))
    port = F.when(v6, F.regexp_extract(text, r"^\[.*?\]:(.*)$", 1)).otherwise(F.regexp_extract(text, r":([^:]*)$", 1))
    number = F.when(F.trim(port).rlike(r"^\+?[0-9]{1,9}$"), F.trim(port).cast("int"))
    return F.when(addr == "*", "0.0.0.0").otherwise(addr), F.when(number <= 65535, number)


def _listeners(l: DataFrame, at: Column, pid: Column, process: Column) -> DataFrame:
    addr, port = _address(at)
    return l.select("asset_id", F.lit("tcp").alias("proto"), addr.alias("local_addr"), port.alias("port"), pid.try_cast("long").alias("pid"), process.alias("process")).where(F.col("port").isNotNull())


def ss_listeners(raw: DataFrame) -> DataFrame:
    l = _lines(raw).withColumn("w", F.split(F.trim("line"), r"\s+")).where((F.get("w", 0) == "LISTEN") & (F.size("w") >= 4))
    rest = F.array_join(F.slice("w", 5, F.size("w")), " ")
    name = F.regexp_extract(rest, r'\(\("([^"]*)"', 1)
    return _listeners(l, F.get("w", 3), F.regexp_extract(rest, "pid=([0-9]+)", 1), F.when(rest.rlike(r'\(\("[^"]*"'), name))


def netstat_listeners(raw: DataFrame) -> DataFrame:
    l = _lines(raw).withColumn("w", F.split(F.trim("line"), r"\s+"))
    l = l.where((F.size("w") >= 5) & (F.upper(F.get("w", 0)) == "TCP") & F.exists("w", lambda x: F.upper(x) == "LISTENING"))
    return _listeners(l, F.get("w", 1), F.element_at("w", -1), F.lit(None).cast("string"))


def lsof_listeners(raw: DataFrame) -> DataFrame:
    l = _lines(raw).withColumn("w", F.split(F.trim("line"), r"\s+")).withColumn("at", F.array_position("w", "(LISTEN)")).where("at > 1")
    return _listeners(l, F.get("w", (F.col("at") - 2).cast("int")), F.get("w", 1), F.get("w", 0))


def resolve_processes(listeners: DataFrame, tasks: DataFrame) -> DataFrame:
    """Listeners without a process take the name that a task list (asset_id, text: CSV of image and pid) has for their pid."""
    t = _lines(tasks).select("asset_id", F.regexp_extract("line", r'^"([^"]*)","([0-9]+)"', 1).alias("image"), F.regexp_extract("line", r'^"([^"]*)","([0-9]+)"', 2).try_cast("long").alias("pid"))
    t = t.where("pid IS NOT NULL").groupBy("asset_id", "pid").agg(F.first("image").alias("image"))
    j = listeners.join(t, ["asset_id", "pid"], "left")
    return j.withColumn("process", F.coalesce("process", F.regexp_replace("image", r"(?i)\.exe$", ""))).select(*listeners.columns)


def expand_cidr(cidr: Column, most: int) -> Column:
    """All addresses of a block, host bits masked; empty for what is malformed or larger than `most`."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    fine = cidr.rlike(rf"^{octet}(\.{octet}){{3}}/([0-9]|[12][0-9]|3[0-2])$")
    o = F.split(F.substring_index(cidr, "/", 1), r"\.")
    ip = sum((F.get(o, k).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0).cast("long"))
    size = F.pow(F.lit(2), 32 - F.substring_index(cidr, "/", -1).cast("int")).cast("long")
    low = ip - ip % size
    dotted = lambda x: F.concat_ws(".", *[(F.shiftright(x, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)])
    return F.when(fine & (size <= most), F.transform(F.sequence(low, low + size - 1), dotted)).otherwise(F.array().cast("array<string>"))
