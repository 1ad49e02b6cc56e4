"""OCSF records: rows of the engine to envelopes, envelopes back to findings, and a whole run over all classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.operators import findings as O
from emberwatch.operators.scorecard import CLASSES
from emberwatch.operators.vulnerabilities import reachability
from emberwatch.sources.feeds import lenient, of_class
from emberwatch.sources.shared import cut

#: Posture records by class: where they stand, their fields, and which of these say that a record is a finding.
POSTURE = {
    2003: ("compliance", "control_id string,passed boolean,weight float,subject string,location string,remediation_key string", "control_id", "NOT passed"),
    5002: ("drift", "entry_id string,drifted boolean,weight float,subject string,location string,remediation_key string", "entry_id", "drifted"),
    2004: ("fim", "entry_id string,violated boolean,weight float,path string,remediation_key string", "entry_id", "violated"),
}
#: What an activity record adds to a finding, by class.
ACTIVITY = {1007: O.process_contribution, 4001: O.network_contribution, 1001: O.file_contribution, 9002: O.correlation_contribution}


def envelopes(rows: DataFrame, class_uid: int, time: Column, severity: Column, data: Column, host: Column | None = None, os: Column | None = None) -> DataFrame:
    """A record a row, `data` (a struct) as its JSON."""
    return rows.select(
        F.lit(class_uid).alias("class_uid"), F.lit(CLASSES[class_uid]).alias("class_name"), time.cast("long").alias("time"), severity.cast("short").alias("severity_id"),
        F.struct(F.lit("emberwatch").alias("product"), F.lit("1").alias("version"), F.lit("main").alias("tenant_id")).alias("metadata"),
        F.struct((F.col("asset_id") if host is None else host).alias("hostname"), (F.lit("linux") if os is None else os).alias("os"), F.lit("").alias("os_version")).alias("device"),
        F.to_json(data).alias("data"),
    )


def parsed_data(records: DataFrame) -> DataFrame:
    """With `data` as an object of the record, as event files have it, not as a string."""
    return records.withColumn("data", F.parse_json("data"))


#: Blocks of an activity record: the columns that they take, as far as there are, and their names within.
BLOCKS = {
    "process": {"image": "image", "pid": "pid", "attributed": "attributed", "process_hits": "detections"},
    "connection": {"daddr": "daddr", "dport": "dport", "connection_hits": "detections"},
    "file": {"path": "path", "file_hits": "detections"},
}


def activity_envelopes(records: DataFrame, class_uid: int, severity: Column) -> DataFrame:
    """Records with `hits`, the record's own detections, and what BLOCKS names: class 1007, 4001, 1001 or 9002. Of the last,
    the blocks have detections of their own, and the process tells whether it is attributed."""
    have = set(records.columns)
    block = lambda names: [F.col(c).alias(n) for c, n in names.items() if c in have]
    data = F.struct(*[F.struct(*block(names)).alias(name) for name, names in BLOCKS.items() if block(names)], F.col("hits").alias("detections"))
    return envelopes(records, class_uid, F.col("ts"), severity, data)


def posture_envelopes(results: DataFrame, class_uid: int, time: Column) -> DataFrame:
    """A record a host with all its results: class 2003, 5002 or 2004."""
    name, fields, _, _ = POSTURE[class_uid]
    row = F.struct(*[F.col(f.split()[0]) for f in fields.split(",")])
    per_host = results.groupBy("asset_id").agg(F.array_sort(F.collect_list(row)).alias("records"))
    return envelopes(per_host, class_uid, time, F.lit(1), F.struct(F.struct("records").alias(name)))


def sbom_envelopes(components: DataFrame, time: Column) -> DataFrame:
    """A record a host (asset_id, os): its components (name, version, source, and libraries if there are any) and their
    number, under `sbom`. Class 5020."""
    parts = [c for c in ("name", "version", "source", "libraries") if c in components.columns]
    g = components.groupBy("asset_id", "os").agg(F.array_sort(F.collect_list(F.struct(*parts))).alias("components"), F.count("*").alias("component_count"))
    g = g.withColumn("sbom", F.struct(F.lit("emberwatch").alias("format"), "components", "component_count"))
    return envelopes(g, 5020, time, F.lit(1), F.struct("sbom"), os=F.coalesce("os", F.lit("")))


#: What the mappers read of a record's `data`. Lists stay raw text, as their elements are taken one by one.
DATA = "process struct<image:string>, connection struct<daddr:string,dport:string>, file struct<path:string>, module struct<path:string>, detections string, compliance struct<records:string>, drift struct<records:string>, fim struct<records:string>, sbom struct<components:string>"


def parsed(records: DataFrame) -> DataFrame:
    """(class_uid, asset_id, os, time, d) with `d` the fields of `data` that mappers read, parsed once a record."""
    return records.select("class_uid", F.col("device.hostname").alias("asset_id"), F.col("device.os").alias("os"), "time", F.from_json("data", DATA).alias("d"))


def activity_of(records: DataFrame, class_uid: int) -> DataFrame:
    """(asset_id, image, daddr, dport, path, hits) of a class. What is no array of detections is none."""
    return parsed(of_class(records, class_uid)).select("asset_id", *[c.alias(n) for n, c in _activity().items()])


def _activity() -> dict[str, Column]:
    hits = lenient(F.col("d.detections"), "rule string,reason string", ["rule"])
    return {"image": F.col("d.process.image"), "daddr": F.col("d.connection.daddr"), "dport": F.col("d.connection.dport").try_cast("long"), "path": F.col("d.file.path"), "hits": hits}


def _posture(class_uid: int) -> Column:
    """Contributions of a posture record: those of its results that are findings."""
    name, fields, key, found = POSTURE[class_uid]
    items = lenient(F.col(f"d.{name}.records"), fields, [f.split()[0] for f in fields.split(",")])
    keep = {"NOT passed": lambda r: ~r["passed"], "drifted": lambda r: r["drifted"], "violated": lambda r: r["violated"]}[found]
    component, location = (lambda r: r["path"], lambda r: F.lit("filesystem")) if class_uid == 2004 else (lambda r: r["subject"], lambda r: r["location"])
    return F.transform(F.filter(items, keep), lambda r: O.contribution(r[key], component(r), location(r), r["weight"], r["remediation_key"]))


def posture_of(records: DataFrame, class_uid: int) -> DataFrame:
    """Contributions (identity, weight, remediation_key) of the records of a posture class that are findings."""
    return parsed(of_class(records, class_uid)).select("asset_id", F.explode(_posture(class_uid)).alias("c")).select("asset_id", "c.*")


def contributions(records: DataFrame) -> DataFrame:
    """Contributions (identity, weight, remediation_key) of records of all classes but inventories, in one pass: a record
    goes to its class' mapper, and is parsed once; inventories, which are long, and other classes aren't parsed at all."""
    p = parsed(records.where(F.col("class_uid").isin(*ACTIVITY, *POSTURE))).withColumns(_activity())
    made = F.array().cast(O.CONTRIBUTIONS)
    for uid, of in ACTIVITY.items():
        made = F.when(F.col("class_uid") == uid, F.array_compact(F.array(of()))).otherwise(made)
    for uid in POSTURE:
        made = F.when(F.col("class_uid") == uid, _posture(uid)).otherwise(made)
    return p.select("asset_id", F.explode(made).alias("c")).select("asset_id", "c.*")


def components_of(records: DataFrame) -> DataFrame:
    """(asset_id, name, version, source, os) of the inventories."""
    items = lenient(F.col("d.sbom.components"), "name string,version string,source string", ["name", "version", "source"])
    return parsed(of_class(records, 5020)).select("asset_id", "os", F.explode(items).alias("c")).select("asset_id", "c.name", "c.version", "c.source", "os").distinct()


def library_items() -> Column:
    """Components with a name and their libraries, of a parsed inventory."""
    items = lenient(F.col("d.sbom.components"), "name string,libraries array<string>", ["name"])
    return F.filter(items, lambda c: c["name"] != "")


def libraries_of(records: DataFrame) -> DataFrame:
    """(asset_id, component, path): the libraries of the inventories' packages."""
    c = parsed(of_class(records, 5020)).select("asset_id", F.explode(library_items()).alias("c"))
    return c.select("asset_id", F.col("c.name").alias("component"), F.explode("c.libraries").alias("path")).where("path IS NOT NULL").distinct()


def loads_of(records: DataFrame) -> DataFrame:
    """(asset_id, path) of what was seen loaded."""
    return parsed(of_class(records, 9003)).select("asset_id", F.col("d.module.path").alias("path")).where("path IS NOT NULL").distinct()


def reachability_of(records: DataFrame) -> DataFrame:
    """(asset_id, component, runtime_reachable) of the inventories' packages that have libraries, by the loads among the same
    records. A host without loads has no row: nothing is known of it."""
    return reachability(libraries_of(records), loads_of(records))


def load_envelopes(loads: DataFrame, time: Column) -> DataFrame:
    """A record a load (asset_id, path, and pid and image if known): class 9003."""
    more = [F.col(c) for c in ("pid", "image") if c in loads.columns]
    return envelopes(loads, 9003, time, F.lit(1), F.struct(F.struct("path").alias("module"), *more))


def tool_envelopes(uses: DataFrame, time: Column) -> DataFrame:
    """A record a connection of an AI tool (asset_id, record, scope, tool, via, pid, image, daddr, dport): class 9004."""
    data = F.struct(F.col("record").alias("kind"), "scope", "tool", "via", F.struct("pid", "image").alias("process"), F.struct("daddr", "dport").alias("connection"))
    return envelopes(uses, 9004, time, F.lit(1), data)


def all_class_findings(records: DataFrame, vulnerable: DataFrame | None = None, assets: DataFrame | None = None) -> DataFrame:
    """Findings of all classes of a batch of envelopes: activity, chains and posture in one pass and one aggregate, and
    `vulnerable`, the findings of its inventories. Identities of classes differ, so nothing is merged across them."""
    out = O.weighted_findings(contributions(records), assets).drop("explain")
    if vulnerable is not None:
        v = vulnerable.withColumns({c: F.lit(None).cast("long") for c in ("first_seen", "last_seen", "closed_at") if c not in vulnerable.columns})
        out = out.unionByName(v.select(*out.columns))
    return out


def run_all(records: DataFrame, prior: DataFrame, vulnerable: DataFrame | None = None, assets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings after a look at the prior state, the queue of fixes of those that aren't suppressed). The reference time
    is the batch's. The lists of a fix's members are for those who ask, see findings.fix_slices()."""
    now = O.batch_time(records).first()[0]
    found = cut(O.reconcile(prior, all_class_findings(records, vulnerable, assets), F.lit(now)))
    return found, O.fix_queue(found)
