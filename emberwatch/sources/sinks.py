"""Writers: NDJSON, day-partitioned tables, versioned state, and record streams."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from emberwatch.sources.shared import remove, scratch

__all__ = ["StateTable", "record_lines", "scratch", "stream_by_day", "stream_records", "to_ndjson", "write_by_day", "write_ndjson"]
#: Rows of a file of a day.
ROWS_PER_FILE = 5_000_000


def to_ndjson(df: DataFrame, rename: dict[str, str] | None = None) -> DataFrame:
    """A JSON object a row, with nulls. `rename` sets field names, such as the score's `R`."""
    cols = [F.col(c).alias((rename or {}).get(c, c)) for c in df.columns]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def record_lines(records: DataFrame) -> DataFrame:
    """Lines of records whose `data` is JSON text, such as envelopes() makes it: the text goes into the line as an object, as
    it is, so that it isn't parsed only to be written again."""
    head = F.to_json(F.struct(*[c for c in records.columns if c != "data"]), {"ignoreNullFields": "false"})
    return records.select(F.concat(F.lit('{"data":'), F.coalesce("data", F.lit("null")), F.lit(","), F.substr(head, F.lit(2))).alias("value"))


def write_ndjson(df: DataFrame, path: str, rename: dict[str, str] | None = None, order: list[str] | None = None) -> None:
    """Lines of JSON. With `order` the files hold the rows in that order, one range a file."""
    lines = to_ndjson(df, rename)
    if order:
        rows = df.orderBy(*order)
        lines = to_ndjson(rows, rename)
    lines.write.mode("overwrite").text(path)


def write_by_day(df: DataFrame, path: str, ms: Column, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Parquet by day of an epoch in ms. Rows of a day are brought together first, so a day is not a file a task; a busy
    day has as many writers as its rows need (adaptive execution brings small ones together), dealt by a hash of the whole
    row, and files are bounded by rows."""
    day = df.withColumn("day", F.to_date(F.timestamp_millis(ms)))
    busiest = day.groupBy("day").count().agg(F.max("count")).first()[0] or 0
    ways = max(1, -(-busiest // rows_per_file))
    day.repartition("day", F.pmod(F.xxhash64(*[F.to_json(F.col(c)) if t.startswith(("map", "variant")) else F.col(c) for c, t in df.dtypes]), F.lit(ways))).write.mode("append").option("maxRecordsPerFile", rows_per_file).partitionBy("day").parquet(path)


def stream_by_day(df: DataFrame, path: str, checkpoint: str, ms: Column) -> DataStreamWriter:
    day = df.withColumn("day", F.to_date(F.timestamp_millis(ms)))
    return day.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")


def stream_records(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Records as NDJSON files."""
    return to_ndjson(df).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


class StateTable:
    """State by a key (of findings, if no other is given) as a log of changes: a write adds a segment with the rows of its batch and no other, and a pointer.
    Reading merges the segments that the last pointer names, later rows of an id before earlier ones. Segments of about
    equal size are merged, each time into one of twice the rows, so a row is rewritten a logarithmic number of times, what a
    batch writes follows the batch, and a read meets few segments. Files of a segment are dealt by a hash of the id.

    Pointers are numbered, each is written once and after what it names, and holds all that a reader needs: segments, and
    the last batch of each stream. The last one is found by trying numbers, twice as far each time, so none but it is read.
    A run that fails in between leaves a segment without a pointer, which the next run writes again. All goes through
    Spark's readers and writers, so any store will do. Folders that the last pointer doesn't name are read by readers
    of earlier ones at most; clean() deletes them when there are none.

    A batch that is repeated after a failure changes nothing, and a stream with a new checkpoint, whose batches start at 0
    again, is a stream of its own. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame, key: tuple[str, ...] = ("finding_id",)) -> None:
        self.spark, self.path, self.empty, self.key = spark, path, empty, list(key)
        self._last, self._held = -1, None

    def _read(self, number: int) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.path}/pointer/p={number}").collect()  # one line
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return json.loads(rows[0]["value"]) if rows else None

    def _data_exists(self) -> bool:
        try:
            self.spark.read.schema(self.empty.schema).option("recursiveFileLookup", True).parquet(f"{self.path}/data")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return False
            raise
        return True

    def pointer(self) -> dict:
        """The last pointer: version (-1: no rows yet), segments (number, rows) and the last batch of each stream."""
        none = {"version": None, "batches": {}, "segments": []}
        if self._held is None:
            self._held = self._read(0)
            if self._held is None:
                if self._data_exists():
                    raise ValueError(f"{self.path} has versions, but their pointers are lost")
                return none
            self._last = 0
        step, beyond = 1, None
        while beyond is None or beyond - self._last > 1:
            at = self._last + step if beyond is None else (self._last + beyond) // 2
            found = self._read(at)
            if found is None:
                beyond = at
            else:
                self._last, self._held, step = at, found, step * 2
        return self._held

    def version(self) -> int | None:
        v = self.pointer()["version"]
        return None if v in (None, -1) else v

    def _segments(self, numbers: list[int], ids: DataFrame | None = None) -> DataFrame:
        """Rows of segments, the last of each id; of the given ids alone, which are picked before anything is merged."""
        if not numbers:
            return self.empty
        parts = [self.spark.read.schema(self.empty.schema).parquet(f"{self.path}/data/s={n}").withColumn("_n", F.lit(n)) for n in numbers]
        every = reduce(DataFrame.unionByName, parts)
        if ids is not None:
            every = every.join(ids.select(*self.key).distinct(), self.key, "left_semi")
        if len(numbers) == 1:
            return every.select(*self.empty.columns)
        last = every.groupBy(*self.key).agg(F.max_by(F.struct(*self.empty.columns), "_n").alias("_row"))
        return last.select("_row.*")

    def load(self, ids: DataFrame | None = None) -> DataFrame:
        """The state, or its rows of some ids (the columns of the key)."""
        return self._segments([n for n, _ in self.pointer()["segments"]], ids)

    def _point(self, number: int, pointer: dict) -> None:
        line = json.dumps(pointer)
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/pointer/p={number}")

    def seen(self, stream: str, batch: int) -> bool:
        return batch <= self.pointer()["batches"].get(stream, -1)

    def _write(self, rows: DataFrame, number: int) -> list[int]:
        folder = f"{self.path}/data/s={number}"
        rows.write.mode("overwrite").parquet(folder)
        return [number, self.spark.read.schema(self.empty.schema).parquet(folder).count()]

    def write(self, fresh: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Puts fresh rows into the state, as its next version; of rows of one id the last by `seq`, if there is one, counts.
        False where this batch of this stream is in it already."""
        now = self.pointer()
        if now["version"] is None:
            self._point(0, {"version": -1, "batches": {}, "segments": []})
            now = self.pointer()
        if batch is not None and batch <= now["batches"].get(stream, -1):
            return False
        number = self._last + 1
        row = F.struct(*self.empty.columns)
        one = fresh.groupBy(*self.key).agg(F.max_by(row, "seq" if "seq" in fresh.columns else row).alias("_row")).select("_row.*")
        segment = self._write(one, number)
        batches = now["batches"] | ({stream: batch} if batch is not None else {})
        self._point(number, {"version": now["version"] + 1, "batches": batches, "segments": [*now["segments"], segment]})
        self.compact()
        return True

    def compact(self) -> None:
        """Merges the last segments as long as the one before has no more rows than those behind it together."""
        now = self.pointer()
        kept, merged, rows = list(now["segments"]), [], 0
        while kept and (not merged or kept[-1][1] <= rows):
            merged.insert(0, kept.pop())
            rows += merged[0][1]
        if len(merged) > 1:
            number = self._last + 1
            segment = self._write(self._segments([n for n, _ in merged]), number)
            self._point(number, now | {"segments": [*kept, segment]})

    def dead(self) -> list[str]:
        """Segments that no reader of the last pointer needs. Pointers stay, as they lead to the last one."""
        live = {n for n, _ in self.pointer()["segments"]}
        return [f"{self.path}/data/s={n}" for n in range(self._last + 1) if n not in live]

    def clean(self) -> None:
        """Deletes what dead() tells. Call it when no reader of an earlier pointer is at work."""
        for folder in self.dead():
            remove(self.spark, folder)
