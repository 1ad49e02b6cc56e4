"""Joins of sensor events with the process that caused them.

Process ids repeat across hosts and over time, so everything is keyed by (asset_id, pid) and ordered by (ts, event_id).
An as-of join is one shuffle: events and their contexts go through the same window, where the last context is carried
forward. No row is multiplied, and a busy process is one sorted partition, not a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.functions import rules as R
from emberwatch.sources.shared import cut

# Fixed values, in ms: how long an exited process still explains an event, how long an event waits for a late exec, and
# how far apart the halves of a chain may be.
EXIT_GRACE, LATE_EXEC, CHAIN = 5000, 250, 5000


def _order() -> Window:
    return Window.partitionBy("asset_id", "pid").orderBy("ts", "event_id")


def exit_lifetimes(events: DataFrame) -> DataFrame:
    """Exits with the exec they end: the previous row of the process among execs and exits, if it is an exec."""
    rows = events.where(F.col("kind").isin("ProcessExec", "ProcessExit"))
    prev = F.lag(F.struct("kind", "ts", "image")).over(_order())
    e = rows.withColumn("prev", prev).where("kind = 'ProcessExit'")
    matched = F.col("prev.kind") == "ProcessExec"
    image = F.when(matched, F.col("prev.image")).otherwise(F.col("image"))
    life = F.when(matched, F.greatest(F.col("ts") - F.col("prev.ts"), F.lit(0)))
    e = e.select("event_id", "asset_id", "pid", "ts", image.alias("image"), life.alias("lifetime_ms"), F.coalesce(matched, F.lit(False)).alias("matched"))
    short = R.short_lived(F.col("image"), F.col("lifetime_ms"))
    own = F.when(F.col("matched"), R.image_severity(F.col("image"))).otherwise(1)
    hits = R.hits((short, "short_lived_suspicious", F.concat(F.lit("suspicious image exited after "), F.col("lifetime_ms").cast("string"), F.lit(" ms"))))
    return e.withColumns({"hits": hits, "severity_id": F.greatest(own, F.when(short, 3).otherwise(1)).cast("short")})


def attribute(events: DataFrame, kinds: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Events of `kinds` with the exec that explains them: `ctx` (event_id, ts, image, and the exec's columns of `carry`),
    null where there is none.

    The latest exec at or before the event counts, unless its process exited EXIT_GRACE or longer before the event;
    else the first exec within LATE_EXEC after it. Events without a pid are left out.
    """
    rows = events.where(F.col("kind").isin("ProcessExec", "ProcessExit", *kinds) & F.col("pid").isNotNull())
    exec_ = F.when(F.col("kind") == "ProcessExec", F.struct("event_id", "ts", "image", *carry))
    exit_ts = F.when(F.col("kind") == "ProcessExit", F.col("ts"))
    past = _order().rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("asset_id", "pid").orderBy("ts").rangeBetween(1, LATE_EXEC - 1)
    w = rows.withColumns({"e": exec_, "x": exit_ts}).withColumns({"back": F.last("e", True).over(past), "last_exit": F.last("x", True).over(past), "ahead": F.first("e", True).over(later)})
    ended = F.col("last_exit").isNotNull() & (F.col("last_exit") >= F.col("back.ts")) & (F.col("ts") - F.col("last_exit") >= EXIT_GRACE)
    ctx = F.when(F.col("back").isNotNull() & ~ended, F.col("back")).otherwise(F.col("ahead"))
    return w.where(F.col("kind").isin(*kinds)).withColumn("ctx", ctx).drop("e", "x", "back", "last_exit", "ahead", *carry)


def same_instance(image: Column, context_image: Column) -> Column:
    """Whether an event's own image names the context: it is empty, `unknown`, or a prefix of the context's file name."""
    name = F.substring_index(context_image, "/", -1)
    own = F.substring_index(F.coalesce(image, F.lit("")), "/", -1)
    return (own == "") | (own == "unknown") | name.startswith(own)


def flagged_path() -> Column:
    """Whether an event's path is watched."""
    return F.col("path").isNotNull() & R.watched(F.col("path"))


def event_severity(flagged: Column) -> Column:
    """Severity of a connection, write or read by itself. `flagged`: see flagged_path()."""
    connect, write, read = (F.col("kind") == k for k in ("NetConnect", "FileWrite", "FileOpen"))
    hit = lambda writes: F.size(R.file_hits(F.col("path"), F.lit(writes))) > 0
    return F.when(connect, R.network_severity(F.col("daddr"), F.col("dport"))).when(write & flagged, F.when(hit(True), 4).otherwise(1)).when(read & flagged, F.when(hit(False), 3).otherwise(1)).otherwise(1)


def with_inherited(events: DataFrame) -> DataFrame:
    """Adds `effective` and `suspicious_ancestor` to execs, see ancestry(); null on other events. Only execs are joined, each
    by its own id, so a long-lived parent is no hot key, and what follows carries an exec's severity along with its image."""
    is_exec = F.col("kind") == "ProcessExec"
    known = ancestry(events).select("asset_id", "event_id", "effective", "suspicious_ancestor")
    execs = events.where(is_exec).join(known, ["asset_id", "event_id"], "left").select(*events.columns, "effective", "suspicious_ancestor")
    others = events.where(~is_exec).withColumns({"effective": F.lit(None).cast("short"), "suspicious_ancestor": F.lit(None).cast("boolean")})
    return execs.unionByName(others)


def correlated(events: DataFrame) -> DataFrame:
    """Connections, watched writes and sensitive reads with their process, severities and combined rule.

    A process is as suspicious as the most suspicious of its image and its ancestors, so a harmless child of a suspicious
    parent makes the rules fire, and chains cross forks and execs. `inherited` tells that an ancestor was suspicious. An
    event whose own image names another instance than the context counts by that image alone."""
    at = attribute(with_inherited(events), ["NetConnect", "FileWrite", "FileOpen"], ("effective", "suspicious_ancestor"))
    same = F.coalesce(F.col("ctx").isNotNull() & same_instance(F.col("image"), F.col("ctx.image")), F.lit(False))
    process = F.when(F.col("ctx").isNull() | same, F.col("ctx.image")).otherwise(F.col("image"))
    connect, write, read = (F.col("kind") == k for k in ("NetConnect", "FileWrite", "FileOpen"))
    flagged = flagged_path()
    own = event_severity(flagged)
    severity = F.when(same, F.col("ctx.effective")).when(F.col("ctx").isNotNull(), R.image_severity(F.col("image"))).otherwise(1)
    inherited = same & F.coalesce("ctx.suspicious_ancestor", F.lit(False))
    out = at.withColumns({"attributed": F.col("ctx").isNotNull(), "process": process, "process_severity": severity.cast("short"), "inherited": inherited, "event_severity": own.cast("short"), "exec_id": F.col("ctx.event_id")})
    both = (F.col("process_severity") > 1) & (F.col("event_severity") > 1)
    rule = F.when(both & connect, "suspicious_process_suspicious_connection").when(both & write, "suspicious_process_suspicious_file_write")
    out = out.withColumns({"rule": rule, "severity_id": F.when(rule.isNotNull(), 4).otherwise(F.greatest("process_severity", "event_severity")).cast("short")})
    return out.where(connect | (write & flagged) | (read & (F.col("event_severity") > 1) & F.col("attributed"))).drop("ctx")


#: Chains by name: the kind of the half that isn't a connection, the rule, and whether that half's own rule must have fired.
CHAINS = {
    "dropper": ("FileWrite", "suspicious_process_wrote_file_and_connected", True),
    "exfil": ("FileOpen", "suspicious_process_read_sensitive_and_connected", False),
}


def chains(records: DataFrame, which: list[str] | None = None) -> DataFrame:
    """Chains of a half of the first kind and a connection whose rule fired, of one process instance, less than CHAIN
    apart in either order; once per epoch. An epoch ends where CHAIN or more passes between halves. `halves` has the
    rules of both.

    Epochs are gaps and islands over the halves, so a chain is found by window aggregates, without a self-join; a record
    goes through them once for each kind of chain that it can be a half of, so all kinds are one pass."""
    used = {name: CHAINS[name] for name in which or CHAINS}
    fired = F.col("rule").isNotNull()
    part_of = [F.when(((F.col("kind") == "NetConnect") & fired) | ((F.col("kind") == first) & (fired if needs else F.lit(True))), F.lit(name)) for name, (first, _, needs) in used.items()]
    halves = records.where("attributed").withColumn("chain_of", F.explode(F.array_compact(F.array(*part_of))))
    is_connect = F.col("kind") == "NetConnect"
    w = Window.partitionBy("asset_id", "pid", "exec_id", "chain_of").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w)
    halves = halves.withColumn("epoch", F.sum(F.when(gap >= CHAIN, 1).otherwise(0)).over(w))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    a = F.last(F.when(~is_connect, F.struct("ts", "event_id", "path", "rule")), True).over(past)
    b = F.last(F.when(is_connect, F.struct("ts", "event_id", "daddr", "dport", "rule")), True).over(past)
    other = halves.withColumns({"a": a, "b": b})
    rules = lambda x, y: F.array_compact(F.array(x, y)).alias("halves")
    ends = F.when(is_connect & (F.col("ts") - F.col("a.ts") < CHAIN), F.struct(F.col("a.event_id").alias("first_id"), F.col("event_id").alias("connect_id"), F.col("a.path").alias("path"), "daddr", "dport", rules(F.col("a.rule"), F.col("rule"))))
    ends = ends.when(~is_connect & (F.col("ts") - F.col("b.ts") < CHAIN), F.struct(F.col("event_id").alias("first_id"), F.col("b.event_id").alias("connect_id"), "path", F.col("b.daddr").alias("daddr"), F.col("b.dport").alias("dport"), rules(F.col("rule"), F.col("b.rule"))))
    found = other.withColumn("chain", ends).where("chain IS NOT NULL")
    once = Window.partitionBy("asset_id", "pid", "exec_id", "chain_of", "epoch").orderBy("ts", "event_id")
    rule = F.lit(None).cast("string")
    for name, (_, fires, _) in used.items():
        rule = F.when(F.col("chain_of") == name, fires).otherwise(rule)
    return found.withColumn("r", F.row_number().over(once)).where("r = 1").select("asset_id", "pid", "exec_id", "ts", "process", "inherited", "chain.*", rule.alias("rule"))


def dropper_chains(records: DataFrame) -> DataFrame:
    return chains(records, ["dropper"])


def exfil_chains(records: DataFrame) -> DataFrame:
    return chains(records, ["exfil"])


def detections_of_chain(chain: DataFrame) -> DataFrame:
    """Adds `hits`, the chain record's top-level detections (rule, reason): for an exfiltration the sensitive read's, the
    connection's and the chain's, for a dropper the chain's rule alone."""
    hit = lambda r, why: F.struct(r.alias("rule"), F.lit(why).alias("reason"))
    own = F.array(hit(F.col("rule"), "both halves of one process, close together"))
    read = hit(F.lit("read_of_sensitive_file"), "first half")
    exfil = F.concat(F.array(read), F.transform("halves", lambda r: hit(r, "second half")), own)
    return chain.withColumn("hits", F.when(F.col("rule") == CHAINS["exfil"][1], exfil).otherwise(own))


def parent_execs(events: DataFrame) -> DataFrame:
    """Execs with the exec of their parent: the latest one of the parent's pid on the host, unless that process exited
    EXIT_GRACE or longer before. One shuffle, keyed by the parent's pid."""
    e = events.where(F.col("kind").isin("ProcessExec", "ProcessExit"))
    cols = ["asset_id", "ts", "event_id", "image"]
    own = e.select(F.col("pid").alias("key"), F.when(F.col("kind") == "ProcessExec", F.struct("event_id", "ts")).alias("e"), F.when(F.col("kind") == "ProcessExit", F.col("ts")).alias("x"), *cols, F.lit(False).alias("asks"))
    asks = e.where("kind = 'ProcessExec'").select(F.col("ppid").alias("key"), F.lit(None).cast("struct<event_id:bigint,ts:bigint>").alias("e"), F.lit(None).cast("long").alias("x"), *cols, F.lit(True).alias("asks"))
    w = Window.partitionBy("asset_id", "key").orderBy("ts", "event_id", "asks").rowsBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(asks).withColumns({"back": F.last("e", True).over(w), "last_exit": F.last("x", True).over(w)}).where("asks")
    ended = F.col("last_exit").isNotNull() & (F.col("last_exit") >= F.col("back.ts")) & (F.col("ts") - F.col("last_exit") >= EXIT_GRACE)
    parent = F.when(F.col("key").isNotNull() & (F.col("back.event_id") != F.col("event_id")) & ~F.coalesce(ended, F.lit(False)), F.col("back.event_id"))
    return both.select("asset_id", "event_id", "ts", "image", parent.alias("parent_id"))


def ancestry(events: DataFrame, rounds: int = 40) -> DataFrame:
    """Effective severity of each exec: the greatest of its own and all its ancestors'; `suspicious_ancestor` where the
    parent's effective one is above 1. Pointer jumping: a round doubles the distance, so the number of joins is the
    logarithm of the deepest lineage. Rounds are cut by reliable checkpoints. More than `rounds` means a circle of
    parents, which is an error."""
    base = cut(parent_execs(events).withColumn("own", R.image_severity(F.col("image"))))
    state = base.select("asset_id", "event_id", F.col("own").alias("sev"), F.col("parent_id").alias("ptr"))
    for k in range(rounds + 1):
        if state.where("ptr IS NOT NULL").isEmpty():
            break
        if k == rounds:
            raise ValueError(f"lineages don't end within 2^{rounds} parents")
        up = state.select("asset_id", F.col("event_id").alias("ptr"), F.col("sev").alias("up_sev"), F.col("ptr").alias("up_ptr"))
        state = state.join(up, ["asset_id", "ptr"], "left").select("asset_id", "event_id", F.greatest("sev", F.coalesce("up_sev", F.lit(1))).cast("short").alias("sev"), F.col("up_ptr").alias("ptr"))
        state = cut(state)
    parents = state.select("asset_id", F.col("event_id").alias("parent_id"), F.col("sev").alias("parent_sev"))
    out = base.join(state.select("asset_id", "event_id", "sev"), ["asset_id", "event_id"]).join(parents, ["asset_id", "parent_id"], "left")
    return out.select("asset_id", "event_id", "ts", "image", "parent_id", "own", F.col("sev").alias("effective"), (F.coalesce("parent_sev", F.lit(1)) > 1).alias("suspicious_ancestor"))
