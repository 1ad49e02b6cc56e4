"""Best-fit packing of documents into bins of fixed capacity, under conflicts of source and duplicate cluster."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import table

#: Rows of a packing shard. Work and memory of a task follow it, not the table.
SHARD_ROWS = 4096
CAPACITY = 8192
SCHEMA = "shard long, bin long, slot int, id long, piece int, start long, length long, bin_filled long"
#: Bins that the successor search looks at in one step.
STRIDE = 128


def pack_shard(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, items taken in the given order. Sources and clusters: codes from 0, -1 for none.

    Open bins are ordered by (residual, bin). A bin carries a bitmap of the sources and one of the duplicate
    clusters in it. The search starts at the successor of the item's size and goes on until the first bin, which
    is the tightest, whose bitmaps have neither bit set.
    """
    n = len(sizes)
    words = lambda codes: max(1, (int(codes.max(initial=-1)) + 64) // 64)
    has_source = np.zeros((n, words(sources)), np.uint64)
    has_cluster = np.zeros((n, words(clusters)), np.uint64)
    order: list[tuple[int, int]] = []
    out, opened = np.empty(n, np.int64), 0
    for i in range(n):
        size, s, c = int(sizes[i]), int(sources[i]), int(clusters[i])
        sw, sb = s >> 6, np.uint64(1 << (s & 63)) if s >= 0 else np.uint64(0)
        cw, cb = c >> 6, np.uint64(1 << (c & 63)) if c >= 0 else np.uint64(0)
        at, found = bisect_left(order, (size, -1)), -1
        while at < len(order) and found < 0:
            bins = np.fromiter((b for _, b in order[at : at + STRIDE]), np.int64)
            free = ((has_source[bins, sw] & sb) == 0) & ((has_cluster[bins, cw] & cb) == 0)
            if free.any():
                found = at + int(free.argmax())
            at += STRIDE
        if found < 0:
            residual, b, opened = capacity, opened, opened + 1
        else:
            residual, b = order.pop(found)
        out[i] = b
        has_source[b, sw] |= sb
        has_cluster[b, cw] |= cb
        if residual > size:
            insort(order, (residual - size, b))
    return out


def _packer(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Pieces: whole bins first, for what is longer than a bin; the rest is packed.
        pdf = pdf.sort_values(["length", "id", "cluster"], ascending=[False, True, True], na_position="last", kind="stable").reset_index(drop=True)
        length = pdf["length"].to_numpy(np.int64)
        full, tail = length // capacity, length % capacity
        tail = np.where((full > 0) & (tail == 0), -1, tail)  # nothing is left to pack
        rows = np.flatnonzero(tail >= 0)
        rows = rows[np.argsort(-tail[rows], kind="stable")]
        code = lambda x: pd.factorize(x)[0]
        bins = pack_shard(tail[rows], code(pdf["source"].to_numpy(object)[rows]), code(pdf["cluster"].to_numpy(object)[rows]), capacity)
        used = int(bins.max(initial=-1)) + 1
        own = np.repeat(np.arange(len(pdf)), full)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)
        row, piece = np.concatenate([rows, own]), np.concatenate([full[rows], nth])
        size = np.concatenate([tail[rows], np.full(len(own), capacity)])
        out = pd.DataFrame({"shard": pdf["shard"].iloc[0], "bin": np.concatenate([bins, used + np.arange(len(own))]), "id": pdf["id"].astype("Int64").to_numpy()[row], "piece": piece, "start": piece * capacity, "length": size})
        out["slot"] = out.groupby("bin").cumcount()
        out["bin_filled"] = out.groupby("bin")["length"].transform("sum")
        return out[[x.split()[0] for x in SCHEMA.split(", ")]]

    return run


def pack_best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", capacity: int = CAPACITY, length: Column | None = None, cluster: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pack documents, longest first, each into the tightest open bin that holds neither its source nor its cluster.

    One row a piece: `shard`, `bin` (in the shard), `slot`, `id`, `piece`, `start`, `length` (in the unit of
    `length`, code points of the text if not given) and `bin_filled`, the sum of the bin. `cluster`: what must not
    meet itself in a bin; the MD5 of the text if not given, so that copies never share a bin. A document longer
    than a bin gives whole bins of its own and a rest, which is packed as others are.

    Null or empty text: length 0, a piece of that length (so that no row is lost); all of these are copies of each
    other. Null source: no conflict of source. Null ids stay null. Ties go to the smaller id, then cluster.
    Repeated rows are copies of each other, however many there are. No rows: no rows. Other columns are not read, and
    their names don't matter.

    Only ids, lengths, sources and cluster keys are shuffled, never texts. A row's shard comes from a hash of its
    id, its cluster and, of equal rows, a number, and the number of shards from the count of rows; so a hot source,
    cluster or id is spread evenly, and a task's work is bounded by `shard_rows`, whatever the table's size.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    light = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.length(body) if length is None else F.coalesce(length, F.lit(0))).cast("long").alias("length"),
        F.col(source_col).cast("string").alias("source"),
        F.unhex(F.md5(body) if cluster is None else F.md5(F.coalesce(cluster.cast("string"), F.lit("")))).alias("cluster"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    # Equal rows of an input partition get numbers. Which rows a partition has doesn't change when it is worked out again.
    light = light.withColumn("part", F.spark_partition_id())
    light = light.groupBy(*light.columns).agg(F.count("*").cast("int").alias("n")).withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("n"))))
    light = light.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", F.when(F.col("nth") > 1, F.struct("part", "nth"))), F.lit(shards)))
    light = light.drop("part", "n", "nth")
    return light.groupBy("shard").applyInPandas(_packer(capacity), SCHEMA)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_best_fit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.withColumnRenamed("id", "doc_id")
