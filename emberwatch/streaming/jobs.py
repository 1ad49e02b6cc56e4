"""Structured Streaming: sources, stateless rules, stateful attribution, gates, trends and the findings loop.

Event time is the events' own `ts`. State is keyed by (asset_id, pid), by the host where lineages matter, or by the
snapshot's key, all of them in a fixed number of groups; rows wait in state until the watermark has passed what could still change their answer, and are then
worked on in event order, so a stream gives the rows that the batch operators give for the same events.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from emberwatch.functions import ai as A
from emberwatch.functions import rules as R
from emberwatch.operators import findings as O
from emberwatch.operators import records as C
from emberwatch.operators.asof import CHAIN, CHAINS, EXIT_GRACE, LATE_EXEC, event_severity, flagged_path
from emberwatch.sources.feeds import parse_envelopes
from emberwatch.sources.shared import cut
from emberwatch.sources.sinks import StateTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "event_id long, asset_id string, kind string, ts long, pid long, ppid long, image string, cmdline string, image_trusted boolean, daddr string, dport int, proto string, path string"
ATTRIBUTED = "event_id long, asset_id string, pid long, kind string, ts long, exec_id long, exec_image string"
CORRELATED = "record string, event_id long, asset_id string, pid long, ts long, kind string, process string, exec_id long, process_severity int, inherited boolean, event_severity int, rule string, severity_id int, first_id long, connect_id long"
TOOLS = "event_id long, asset_id string, pid long, tool string, via string, scope string, record string"
CHANGES = "asset_id string, class_uid int, ts long, seq long, payload string"
LIFETIMES = "event_id long, asset_id string, pid long, image string, lifetime_ms long, matched boolean"


def event_stream(spark: SparkSession, folder: str, kinds: list[str] | None = None, delay: str = "10 seconds") -> DataFrame:
    """Sensor events of a folder of Parquet files, with `event_time`."""
    e = spark.readStream.schema(EVENT).parquet(folder)
    e = e.where(F.col("kind").isin(kinds)) if kinds else e
    return with_event_time(e, "ts", delay)


def envelope_stream(spark: SparkSession, folder: str, delay: str = "10 seconds") -> DataFrame:
    """Envelopes of a folder of NDJSON files."""
    return with_event_time(parse_envelopes(spark.readStream.text(folder))[0], "time", delay)


def with_event_time(df: DataFrame, ms: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_millis(F.col(ms))).withWatermark("event_time", delay)


#: Entries that a group's processes are kept in: one is read and written as a whole.
SHARDS = 8
#: How long a process without an event and without an exit is remembered, unless a stream is told otherwise (ms).
IDLE = 30 * 86_400_000


@contextmanager
def _no_collection() -> Iterator[None]:
    """Rows are many small objects that make no circles; looking for some over and over costs as much as the work."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


class _Buffered(StatefulProcessor):
    """Rows wait in state until the watermark is `wait` ms past them; then `ready` gets those of one owner (`owner`: its
    fields) in event order. A group is one of GROUPS of owners, so what a batch costs follows its rows, not its owners: rows
    of a batch wait as one entry a `bucket` ms of event time, and a timer for the earliest ones reads the entries that are due
    and what stands within `wait` behind them. A row (`fields`, its own id first) comes as JSON text, is put away as it comes,
    and is parsed when it is due. What a process has left behind is a dictionary, and those of a group
    are kept in SHARDS entries. It is freed `linger` ms after the last event where no exec is known, and after `idle` ms without
    an event otherwise; from then on the stream answers as if the process had never been seen, unlike the batch operator. An
    exit alone frees nothing: where another one follows it, the exec explains what comes within EXIT_GRACE of that."""

    wait, linger, bucket, forgets = 0, 0, 3_600_000, True
    owner = ("asset_id", "pid")
    fields: tuple[str, ...] = ("event_id", "kind", "ts", "image", "asset_id", "pid")
    schema = ""

    def __init__(self, idle: int = IDLE) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part long", "json string")
        self.parts = handle.getValueState("parts", "part long")
        self.memory = handle.getMapState("memory", "shard long", "json string")
        self.swept = handle.getValueState("swept", "watermark long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, list[str]] = {}
        first = None
        with _no_collection():
            for pdf in rows:
                for ts, row in zip(pdf["ts"].tolist(), pdf["row"].tolist(), strict=True):
                    slots.setdefault(ts // self.bucket, []).append(row)
                earliest = int(pdf["ts"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None:  # a timer for the earliest row
            part = self.parts.get()[0] if self.parts.exists() else 0
            self.parts.update((part + 1,))
            for slot, texts in slots.items():
                self.waiting.updateValue((slot, part), (f"[{','.join(texts)}]",))
            self.handle.registerTimer(first + self.wait)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        with _no_collection():
            out = self._frame(self._work(timerValues.getCurrentWatermarkInMs()))
        yield out

    def _work(self, watermark: int) -> list[tuple]:
        limit, first = watermark - self.wait, None
        due: dict[tuple, list] = {}  # by owner: rows that are due, and what stands behind them
        after: dict[tuple, list] = {}
        for slot, part in sorted(tuple(k) for k in self.waiting.keys()):
            if slot * self.bucket > limit:
                first = slot * self.bucket if first is None else first
                if slot * self.bucket > watermark:
                    break
            rows = json.loads(self.waiting.getValue((slot, part))[0])
            stay = [r for r in rows if r["ts"] > limit] if (slot + 1) * self.bucket > limit else []
            for r in rows if stay else ():
                if limit < r["ts"] <= watermark:
                    after.setdefault(self._owner(r), []).append(r)
            for r in rows:
                if not stay or r["ts"] <= limit:
                    due.setdefault(self._owner(r), []).append(r)
            if not stay:
                self.waiting.removeKey((slot, part))
                continue
            first = min(min(r["ts"] for r in stay), first) if first is not None else min(r["ts"] for r in stay)
            if len(stay) < len(rows):
                self.waiting.updateValue((slot, part), (json.dumps(stay),))
        if first is not None:
            self.handle.registerTimer(max(first + self.wait, watermark + 1))
        ordered = lambda rows: sorted(rows, key=lambda r: (r["ts"], r[self.fields[0]]))
        self.open, self.found, self.changed, out = {}, {}, set(), []
        for self.of, rows in due.items():
            out += self.ready(self.of, ordered(rows), ordered(after.get(self.of, [])))
        for shard in self.changed:
            self.memory.updateValue((shard,), (json.dumps(self.open[shard]),))
        if self.forgets:
            self._sweep(watermark)
        return out

    def _owner(self, row: dict) -> tuple:
        return tuple([row[k] for k in self.owner])

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        names, kinds = zip(*(f.split() for f in self.schema.split(", ")), strict=True)
        pdf = pd.DataFrame(out, columns=names)
        return pdf.astype({n: {"long": "Int64", "int": "Int32"}[k] for n, k in zip(names, kinds, strict=True) if k in ("long", "int")})

    def recall(self, pid: int) -> dict:
        """What is known of a process; changes to it are kept by touch()."""
        found = self.found.get((self.of[0], pid))
        if found is None:
            name = json.dumps([self.of[0], pid])
            shard = zlib.crc32(name.encode()) % SHARDS
            if shard not in self.open:
                kept = self.memory.getValue((shard,))
                self.open[shard] = json.loads(kept[0]) if kept else {}
            found = self.found[self.of[0], pid] = self.open[shard].setdefault(name, {}), shard
        return found[0]

    def touch(self, pid: int, ts: int) -> dict:
        memory = self.recall(pid)
        memory["seen"] = ts
        self.changed.add(self.found[self.of[0], pid][1])
        return memory

    def ends(self, memory: dict) -> int:
        """When what is known of a process can be forgotten."""
        return memory.get("seen", 0) + (self.linger if memory.get("eid") is None else self.idle)

    def _sweep(self, watermark: int) -> None:
        """Frees what has ended, once every `linger` ms of event time at most."""
        last, period = self.swept.get()[0] if self.swept.exists() else None, max(self.linger, self.bucket)
        if last is not None and watermark < last + period:
            self.handle.registerTimer(last + period)
            return
        ends = []
        for shard, known in [(tuple(k)[0], json.loads(tuple(v)[0])) for k, v in self.memory.iterator()]:
            stay = {name: memory for name, memory in known.items() if memory and self.ends(memory) > watermark}
            if not stay:
                self.memory.removeKey((shard,))
                continue
            ends += map(self.ends, stay.values())
            if len(stay) < len(known):
                self.memory.updateValue((shard,), (json.dumps(stay),))
        if ends:
            self.swept.update((watermark,))
            self.handle.registerTimer(max(min(ends), watermark + period))
        else:
            self.swept.clear()

    def close(self) -> None:
        pass


def _exec(memory: dict, row: dict) -> None:
    memory |= {"eid": row["event_id"], "ets": row["ts"], "image": row["image"]}


def _ended(memory: dict, ts: int) -> bool:
    """Whether a process explains nothing any more at `ts`, as it exited before."""
    left = memory.get("last_exit")
    return left is not None and memory.get("ets") is not None and left >= memory["ets"] and ts - left >= EXIT_GRACE


def _chained(every: list[dict]) -> None:
    """Gives each row (`after`) the execs of its process that stand behind it: (the next one, those behind that)."""
    ahead: dict[int, tuple] = {}
    for row in reversed(every):
        row["after"] = ahead.get(row["pid"])
        if row["kind"] == "ProcessExec":
            ahead[row["pid"]] = row, row["after"]


def _context(memory: dict, row: dict) -> dict | None:
    """The exec that explains an event: see operators.asof.attribute."""
    if memory.get("eid") is not None and not _ended(memory, row["ts"]):
        return memory | {"event_id": memory["eid"]}
    node = row["after"]
    while node and node[0]["ts"] < row["ts"] + LATE_EXEC:
        if node[0]["ts"] > row["ts"]:
            return node[0]
        node = node[1]
    return None


class Attribution(_Buffered):
    """Connections, writes and reads with the exec that explains them, as operators.asof.attribute gives."""

    wait, linger, schema = LATE_EXEC, EXIT_GRACE, ATTRIBUTED

    def ready(self, key, now, later) -> list[tuple]:
        out, memory = [], self.touch(key[1], now[-1]["ts"])
        _chained([*now, *later])
        for row in now:
            if row["kind"] == "ProcessExec":
                _exec(memory, row)
            elif row["kind"] == "ProcessExit":
                memory["last_exit"] = row["ts"]
            else:
                found = _context(memory, row) or {}
                out.append((row["event_id"], key[0], key[1], row["kind"], row["ts"], found.get("event_id"), found.get("image")))
        return out


class Lifetimes(_Buffered):
    """Exits with the lifetime of the exec that they end, as operators.asof.exit_lifetimes gives. The exit clears it."""

    schema = LIFETIMES

    def ready(self, key, now, later) -> list[tuple]:
        out = []
        for row in now:
            memory = self.touch(key[1], row["ts"])
            if row["kind"] == "ProcessExec":
                _exec(memory, row)
            else:
                known = memory.get("eid") is not None
                out.append((row["event_id"], key[0], key[1], memory["image"] if known else row["image"], max(row["ts"] - memory["ets"], 0) if known else None, known))
                memory |= {"eid": None, "ets": None, "image": None}
        return out


class Correlation(_Buffered):
    """Connections, watched writes and sensitive reads with their process, severities and rule, and the chains that they
    complete: as operators.asof.correlated and .chains give. Severities of single rows come in as columns.

    The owner is the host, as an exec takes on the severity of its parent, which is another process: when it runs, its
    parent's own context has taken on what it inherits already, so one look goes for the whole lineage."""

    wait, linger, schema, owner = LATE_EXEC, EXIT_GRACE + CHAIN, CORRELATED, ("asset_id",)
    fields = ("event_id", "kind", "ts", "image", "asset_id", "pid", "ppid", "own_severity", "event_severity", "flagged")

    def __init__(self, idle: int = IDLE, events: bool = True) -> None:
        super().__init__(idle)
        self.events = events

    def ready(self, key, now, later) -> list[tuple]:
        out, every = [], [*now, *later]
        self._inherit(every)
        _chained(every)
        for row in now:
            memory = self.touch(row["pid"], row["ts"])
            if row["kind"] == "ProcessExec":
                _exec(memory, row)
                memory |= {"effective": row["effective"], "inherited": row["inherited"]}
            elif row["kind"] == "ProcessExit":
                memory["last_exit"] = row["ts"]
            else:
                out += self._record(key, row, _context(memory, row), memory)
        return out

    def _inherit(self, every: list[dict]) -> None:
        """Effective severities of execs, in event order; nothing is kept."""
        known: dict[int, dict] = {}

        def at(pid: int) -> dict:
            if pid not in known:
                known[pid] = {k: v for k, v in self.recall(pid).items() if k in ("eid", "ets", "last_exit", "effective")}
            return known[pid]

        for row in every:
            if row["kind"] == "ProcessExec":
                parent = at(row["ppid"]) if row["ppid"] is not None and row["ppid"] != row["pid"] else {}
                above = parent["effective"] if parent.get("eid") is not None and not _ended(parent, row["ts"]) else 1
                row |= {"effective": max(row["own_severity"], above), "inherited": above > 1}
                at(row["pid"]).update(eid=row["event_id"], ets=row["ts"], effective=row["effective"])
            elif row["kind"] == "ProcessExit":
                at(row["pid"])["last_exit"] = row["ts"]

    def _record(self, key, row: dict, ctx: dict | None, memory: dict) -> list[tuple]:
        kind = row["kind"]
        if not (kind == "NetConnect" or (kind == "FileWrite" and row["flagged"]) or (kind == "FileOpen" and row["flagged"] and row["event_severity"] > 1 and ctx)):
            return []
        name = (row["image"] or "").rpartition("/")[2]
        same = ctx is None or name in ("", "unknown") or (ctx["image"] or "").rpartition("/")[2].startswith(name)
        process = (ctx["image"] if ctx else None) if same else row["image"]
        severity = 1 if ctx is None else ctx["effective"] if same else row["own_severity"]
        inherited = bool(ctx and same and ctx["inherited"])
        both = severity > 1 and row["event_severity"] > 1
        rule = {"NetConnect": "suspicious_process_suspicious_connection", "FileWrite": "suspicious_process_suspicious_file_write"}.get(kind) if both else None
        exec_id = ctx["event_id"] if ctx else None
        level = 4 if rule else max(severity, row["event_severity"])
        one = (row["event_id"], key[0], row["pid"], row["ts"], kind, process, exec_id, severity, inherited, row["event_severity"])
        out = [("event", *one, rule, level, None, None)] if self.events else []
        for chain, (first, fires, needs) in CHAINS.items() if ctx else ():
            if (kind == "NetConnect" and rule) or (kind == first and (rule or not needs)):
                done = self._half(memory.setdefault("chains", {}), chain, row, exec_id)
                if done:
                    out.append(("chain", *one, fires, 4, *done))
        return out

    @staticmethod
    def _half(chains: dict, chain: str, row: dict, exec_id: int) -> tuple[int, int] | None:
        """Takes a half in; (first half's id, connection's id) where it completes the epoch's chain. An epoch is kept by exec,
        as an event before a late exec may stand between those of the one before, and goes when it can't grow any more."""
        for of in [k for k, c in chains.items() if row["ts"] - c["ts"] >= CHAIN]:
            del chains[of]
        c = chains.setdefault(f"{chain} {exec_id}", {"fired": False})
        c["ts"] = row["ts"]
        mine, other = ("connect", "first") if row["kind"] == "NetConnect" else ("first", "connect")
        done = None
        if other in c and row["ts"] - c[other][0] < CHAIN and not c["fired"]:
            c["fired"] = True
            done = (c["first"][1], row["event_id"]) if mine == "connect" else (row["event_id"], c["connect"][1])
        c[mine] = (row["ts"], row["event_id"])
        return done


class ToolUse(_Buffered):
    """Connections of AI tools: by the connecting image, or, where that is an interpreter, by the command line of the
    interpreter that runs as that process. `tool` is an exec's tool by command line, or a connection's by image."""

    schema = TOOLS
    fields = ("event_id", "kind", "ts", "image", "asset_id", "pid", "tool", "interpreter", "scope")

    def ready(self, key, now, later) -> list[tuple]:
        out = []
        for row in now:
            memory = self.touch(key[1], row["ts"])
            if row["kind"] == "ProcessExec":
                _exec(memory, row)
                memory["tool"] = row["tool"]
            elif row["kind"] == "ProcessExit":
                memory |= {"eid": None, "tool": None}
                continue
            tool = row["tool"] or (memory.get("tool") if row["interpreter"] else None)
            if row["kind"] == "NetConnect" and tool and row["scope"]:
                out.append((row["event_id"], key[0], key[1], tool, "comm" if row["tool"] else "cmdline", row["scope"], "ai_tool_egress" if row["scope"] == "external" else "ai_tool_local"))
        return out


#: Groups that the owners of a stream's state are dealt to.
GROUPS = 256


def _stateful(events: DataFrame, processor: _Buffered) -> DataFrame:
    """Only what the processor asks for goes to Python, as one text a row: what a row costs there grows with its columns."""
    row = F.to_json(F.struct(*processor.fields), {"ignoreNullFields": "false"}).alias("row")
    dealt = events.select(F.pmod(F.xxhash64(*processor.owner), F.lit(GROUPS)).alias("owners"), "ts", row, "event_time")
    return dealt.groupBy("owners").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.schema, outputMode="Append", timeMode="EventTime")


def _of_processes(events: DataFrame) -> DataFrame:
    """Events without a process are no one's."""
    return events.where("asset_id IS NOT NULL AND pid IS NOT NULL AND ts IS NOT NULL")


def attribute_stream(events: DataFrame, idle: int = IDLE) -> DataFrame:
    return _stateful(_of_processes(events), Attribution(idle))


def lifetime_stream(events: DataFrame, idle: int = IDLE) -> DataFrame:
    return _stateful(_of_processes(events).where(F.col("kind").isin("ProcessExec", "ProcessExit")), Lifetimes(idle))


def correlation_stream(events: DataFrame, idle: int = IDLE, single: bool = True) -> DataFrame:
    """Records of single events (`event`; only where `single`) and of chains (`chain`), see Correlation."""
    e = events.where(F.col("kind").isin("ProcessExec", "ProcessExit", "NetConnect", "FileWrite", "FileOpen"))
    e = e.withColumns({"own_severity": R.image_severity(F.col("image")).cast("int"), "event_severity": event_severity(flagged_path()).cast("int"), "flagged": flagged_path()})
    return _stateful(_of_processes(e), Correlation(idle, single))


def tool_stream(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """Connections of AI tools, see ToolUse."""
    e = events.where(F.col("kind").isin("ProcessExec", "ProcessExit", "NetConnect"))
    tool = F.when(F.col("kind") == "NetConnect", A.tool_of(F.col("image"))).when((F.col("kind") == "ProcessExec") & A.is_interpreter(F.col("image")), A.tool_in_cmdline(F.col("cmdline")))
    return _stateful(_of_processes(e).withColumns({"tool": tool, "interpreter": A.is_interpreter(F.col("image")), "scope": R.connection_scope(F.col("daddr"))}), ToolUse(idle))


class ChangeGate(_Buffered):
    """Snapshots whose payload differs from the last one of their key, in event order across batches: a snapshot waits for
    the watermark before it is compared. The last hash of a key is kept for good, as any later snapshot needs it."""

    bucket, forgets, schema, owner = 30 * 86_400_000, False, CHANGES, ("asset_id", "class_uid")
    fields = ("seq", "asset_id", "class_uid", "ts", "hash", "payload")

    def ready(self, key, now, later) -> list[tuple]:
        memory, out = self.touch(key[1], now[-1]["ts"]), []
        for row in now:
            if row["hash"] != memory.get("hash"):
                out.append((key[0], key[1], row["ts"], row["seq"], row["payload"]))
            memory["hash"] = row["hash"]
        return out


def change_gate_stream(snapshots: DataFrame) -> DataFrame:
    """(asset_id, class_uid, ts, seq, payload) rows that change something, in the order of (ts, seq) within a key, however
    they arrive within the watermark's delay. `snapshots` has `event_time`."""
    return _stateful(snapshots.withColumn("hash", F.xxhash64("payload")).where("asset_id IS NOT NULL AND class_uid IS NOT NULL AND ts IS NOT NULL"), ChangeGate())


SIGHTINGS = "asset_id string, path string, ts long"


def first_sighting_stream(loads: DataFrame) -> DataFrame:
    """One row for each path of a host that is new within the watermark's delay: what comes again sooner is dropped, and state
    is freed as the watermark passes. See first_sightings_loop() for what was known before."""
    return loads.where("asset_id IS NOT NULL AND path IS NOT NULL").dropDuplicatesWithinWatermark(["asset_id", "path"])


def first_sightings_loop(loads: DataFrame, known: StateTable, checkpoint: str) -> StreamingQuery:
    """Adds paths of hosts (asset_id, path, ts, event_time) that were never seen to `known`, a table by SIGHTINGS and the key
    (asset_id, path), with the earliest time of the batch that tells them. The stream has no state of its own; what was seen
    earlier is in the table, of which a batch reads the rows of its own paths. Nothing is told twice, not by a repeated batch, nor after a restart, nor by a
    stream with a new checkpoint that reads all from the start."""

    def run(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise ValueError("a batch without a stream")
        if not known.seen(stream, batch_id):
            found = cut(batch.where("asset_id IS NOT NULL AND path IS NOT NULL").groupBy("asset_id", "path").agg(F.min("ts").alias("ts")))
            known.write(found.join(known.load(found).select("asset_id", "path"), ["asset_id", "path"], "left_anti"), stream, batch_id)

    return loads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


REACHED = "asset_id string, component string, runtime_reachable boolean"


class Reachability(StatefulProcessor):
    """Components of a host by whether one of their libraries was seen loaded: null before the host has loads at all, then
    false or true. Inventories (component, path) and loads (path alone) come in any order; a row goes out when a component's
    answer is first known and whenever it changes, which it does upwards only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waits = handle.getMapState("waits", "path string", "components string")
        self.loaded = handle.getMapState("loaded", "path string", "yes boolean")
        self.told = handle.getMapState("told", "component string", "answer string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: dict[str, str] = {}
        has_loads = any(True for _ in self.loaded.keys())
        before = has_loads
        for pdf in rows:
            for component, path in pdf[["component", "path"]].itertuples(index=False):
                if pd.isna(component):
                    has_loads = True
                    if not self.loaded.containsKey((path,)):
                        self.loaded.updateValue((path,), (True,))
                        if self.waits.containsKey((path,)):
                            out |= dict.fromkeys(json.loads(self.waits.getValue((path,))[0]), "yes")
                    continue
                names = json.loads(self.waits.getValue((path,))[0]) if self.waits.containsKey((path,)) else []
                if component not in names:
                    self.waits.updateValue((path,), (json.dumps([*names, component]),))
                if self.loaded.containsKey((path,)):
                    out[component] = "yes"
                elif not self.told.containsKey((component,)):
                    out.setdefault(component, "unknown")
        if has_loads:
            out = {c: "no" if a == "unknown" else a for c, a in out.items()}
            if not before:  # the first loads of the host answer for all that is known
                for c, a in [(tuple(k)[0], tuple(v)[0]) for k, v in self.told.iterator()]:
                    if a == "unknown":
                        out.setdefault(c, "no")
        rank = {"unknown": 0, "no": 1, "yes": 2}
        news = []
        for c, a in out.items():
            old = self.told.getValue((c,))[0] if self.told.containsKey((c,)) else None
            if old is None or rank[a] > rank[old]:
                self.told.updateValue((c,), (a,))
                news.append((key[0], c, {"unknown": None, "no": False, "yes": True}[a]))
        yield pd.DataFrame(news, columns=["asset_id", "component", "runtime_reachable"]).astype({"runtime_reachable": "boolean"})

    def close(self) -> None:
        pass


def reachability_stream(records: DataFrame) -> DataFrame:
    """(asset_id, component, runtime_reachable) out of a stream of envelopes of classes 5020 and 9003, each row once for every
    answer that is new; of the rows of a component the greatest (null, false, true) is what holds. The batch answer for the
    same records is operators.records.reachability_of()."""
    p = C.parsed(records.where(F.col("class_uid").isin(5020, 9003)))
    lists = F.transform(C.library_items(), lambda c: F.struct(c["name"].alias("name"), F.array_compact(c["libraries"]).alias("libraries")))
    owned = F.flatten(F.transform(lists, lambda c: F.transform(F.coalesce(c["libraries"], F.array().cast("array<string>")), lambda l: F.struct(c["name"].alias("component"), l.alias("path")))))
    loads = F.array(F.struct(F.lit(None).cast("string").alias("component"), F.col("d.module.path").alias("path")))
    rows = p.select("asset_id", F.explode(F.when(F.col("class_uid") == 9003, loads).otherwise(owned)).alias("r")).select("asset_id", "r.component", "r.path").where("path IS NOT NULL AND asset_id IS NOT NULL")
    return rows.groupBy("asset_id").transformWithStateInPandas(statefulProcessor=Reachability(), outputStructType=REACHED, outputMode="Append", timeMode="None")


def daily_activity_stream(records: DataFrame, category: str = "category") -> DataFrame:
    """Records by day and category; a day goes out when the watermark has passed it."""
    return records.groupBy(F.window("event_time", "1 day").alias("w"), category).agg(F.count("*").alias("detections")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), category, "detections")


def findings_loop(records: DataFrame, to_findings, state: StateTable, checkpoint: str, time: str = "ts") -> StreamingQuery:
    """Findings of each micro-batch, reconciled with the state and merged into its next version. A batch is known by its
    stream's id, which the checkpoint keeps, and its number, so one that is repeated after a failure changes nothing. Of the
    state only the rows of the batch's own identities are merged, and only these are written. `time`: the records' column
    of epoch ms, whose greatest value is the batch's time."""

    def run(batch: DataFrame, batch_id: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise ValueError("a batch without a stream")
        if state.seen(stream, batch_id):
            return
        batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            now = O.batch_time(batch.withColumnRenamed(time, "time")).first()[0]
            found = cut(to_findings(batch))
            prior = cut(state.load(found))
            state.write(O.carry_forward(O.reconcile(prior, found, F.lit(now)), prior), stream, batch_id)
        finally:
            batch.unpersist()

    return records.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
