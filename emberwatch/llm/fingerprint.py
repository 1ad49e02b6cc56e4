"""Document fingerprints from prefix polynomial hashes.

`Prefix` holds, for each prefix of a text, the sums of (code point + 1) * base^position modulo 2^31 - 1 under two
bases. The difference of two prefixes, shifted back by the inverse power of the start, is the hash of that span, so
any two spans compare in constant time and a binary search gives the longest common extension of two positions.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import shuffle_parts, table

P = np.uint64(2**31 - 1)
BASES = (1103515245, 1812433253)
#: Code points of a span that the sketch hashes, and span hashes that it keeps.
WINDOW, KEEP = 12, 64
_LAST = 2**63 - 1


def _reduce(x: np.ndarray) -> np.ndarray:
    """Modulo 2^31 - 1 of values below 2^62."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x == P, np.uint64(0), x)


class _Powers:
    """Powers of the bases and of their inverses; grown by doubling to the longest text of the task."""

    def __init__(self) -> None:
        self.tables: dict[int, np.ndarray] = {}

    def get(self, base: int, n: int) -> np.ndarray:
        t = self.tables.get(base)
        if t is None:
            t = np.ones(1, np.uint64)
        while len(t) < n:
            t = np.concatenate([t, _reduce(t * np.uint64(pow(base, len(t), int(P))))])
        self.tables[base] = t
        return t[:n]


_POWERS = _Powers()
_INVERSE = {b: pow(b, -1, int(P)) for b in BASES}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefix:
    """Prefix hashes of one text. `sums[b][i]` belongs to the first i code points."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for b in BASES:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_reduce(values * _POWERS.get(b, self.n)), out=s[1:])
            self.sums.append(_reduce(s))

    def span(self, start: int, length: int) -> tuple[int, ...]:
        p = int(P)
        return tuple((int(s[start + length]) - int(s[start])) * pow(_INVERSE[b], start, p) % p for b, s in zip(BASES, self.sums, strict=True))

    def windows(self, width: int = WINDOW) -> np.ndarray:
        """Hashes (first base) of all spans of `width`, cut off at either end of the text."""
        s = self.sums[0]
        ends = np.concatenate([s[min(width, self.n) :], np.full(min(width, self.n) - 1 if self.n else 0, s[-1])])
        inner = _reduce((ends + P - s[: self.n]) * _POWERS.get(_INVERSE[BASES[0]], self.n))
        return np.concatenate([inner, s[1 : min(width, self.n)]])


def spans_equal(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether the spans are equal; false where either leaves its text."""
    if min(i, j, length) < 0 or i + length > a.n or j + length > b.n:
        return False
    return a.span(i, length) == b.span(j, length)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension of position i of a and j of b, by binary search."""
    low, high = 0, max(0, min(a.n - i, b.n - j))
    while low < high:
        mid = (low + high + 1) // 2
        # Longer than `low` is known to be equal: only the new part is compared.
        if a.span(i + low, mid - low) == b.span(j + low, mid - low):
            low = mid
        else:
            high = mid - 1
    return low


def sketch(p: Prefix, keep: int = KEEP) -> np.ndarray:
    """The `keep` least of the distinct, mixed span hashes: a uniform sample of the text's spans."""
    mixed = (p.windows().astype(np.uint32) * np.uint32(0x9E3779B1)).astype(np.uint32)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x85EBCA77)
    if len(mixed) > 64 * keep:
        few = mixed[mixed < np.uint32(min(2**32 - 1, (2**32 * 8 * keep) // len(mixed)))]
        found = np.unique(few)[:keep]
        if len(found) == keep:
            return found
    return np.unique(mixed)[:keep]


def encode(p: Prefix, kept: np.ndarray) -> str:
    whole = p.span(0, p.n)
    return f"{p.n:x}.{whole[0]:08x}{whole[1]:08x}.{kept.astype('>u4').tobytes().hex()}"


def _share(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    seen = np.cumsum(first)
    least = min(int(seen[-1]), keep)
    hits = int(np.count_nonzero(twice & (seen[1:] <= least)))
    j = hits / least
    return 2 * j / (1 + j)


def likeness(a: str, b: str) -> float:
    """Share of common spans (Dice), estimated from two fingerprints; 1 for equal ones."""
    if a == b:
        return 1.0
    kept = [np.frombuffer(bytes.fromhex(x.rpartition(".")[2]), ">u4").astype(np.uint32) for x in (a, b)]
    return _share(*kept)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, n_chars, fingerprint) a row, without a shuffle. Null text counts as empty; repeated rows and null
    ids give rows as they are; no rows give none; other columns are not read."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches):
        for batch in batches:
            ps = [Prefix(code_points(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.n for p in ps], pa.int64()), pa.array([encode(p, sketch(p)) for p in ps], pa.string())], ["id", "n_chars", "fingerprint"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_chars long, fingerprint string").withColumnRenamed("id", id_col)


def common_spans(pairs: DataFrame, a: str, b: str, start_a: str, start_b: str, length: str) -> DataFrame:
    """`pairs` with `equal` (whether the two spans are) and `extension` (longest common one of the two positions).
    Null texts are empty, null starts and lengths are 0; columns named `equal` or `extension` are replaced."""
    kept = [c for c in pairs.columns if c not in ("equal", "extension")]
    src = pairs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        for batch in batches:
            get = lambda c: batch.column(kept.index(c)).to_pylist()  # noqa: B023, E731
            eq, ext = [], []
            for ta, tb, i, j, n in zip(get(a), get(b), get(start_a), get(start_b), get(length), strict=True):
                pa_, pb = Prefix(code_points(ta or "")), Prefix(code_points(tb or ""))
                i, j, n = i or 0, j or 0, n or 0
                eq.append(spans_equal(pa_, i, pb, j, n))
                ext.append(common_extension(pa_, i, pb, j) if i >= 0 and j >= 0 else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(eq, pa.bool_()), pa.array(ext, pa.int64())], [*kept, "equal", "extension"])

    from pyspark.sql import types as T

    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("equal", T.BooleanType()), T.StructField("extension", T.LongType())]))


#: Rows that one row of a counted text stands for at most.
TIMES = 1 << 14


def _neighbours(batches):
    """Rows (bucket, guard, id, body, n), in order; a row goes out when its successor in the bucket is known. `n` equal
    rows follow each other, so all but the last are their own successors."""
    held = None  # bucket, guard, id, body, n, points, prefix, sketch, fingerprint
    for batch in batches:
        out = []

        def edited_with(row, body, points, kept, fp, times):
            _, _, hid, text, _, hp, prefix, hk, own = row
            half = prefix.n // 2
            edited = Prefix(np.concatenate([hp[: prefix.n - half], points[:half]]))
            ek = sketch(edited)
            efp = encode(edited, ek)
            digest = hashlib.sha256((text[: prefix.n - half] + body[:half]).encode("utf-8", "surrogatepass")).hexdigest()
            one = (hid, prefix.n, digest, own, efp, 1.0 if own == efp else _share(hk, ek), 1.0 if own == fp else _share(hk, kept), common_extension(prefix, 0, edited, 0))
            for k in range(0, times, TIMES):
                out.append((*one, min(TIMES, times - k)))  # noqa: B023

        for bucket, guard, i, body, n in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
            if held and held[0] == bucket and held[1]:
                continue  # a second guard
            points = code_points(body)
            p = Prefix(points)
            kept = sketch(p)
            row = (bucket, guard, i, body, n, points, p, kept, encode(p, kept))
            if held and held[0] == bucket:
                edited_with(held, body, points, kept, row[8], 1)
            if n > 1 and not guard:
                edited_with(row, body, points, kept, row[8], n - 1)
            held = row
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix", "times"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose last half is replaced by the start of the next document's.

    `common_prefix` is the longest common extension of the starts of both texts. Order: ascending id, nulls last,
    ties by a hash of the text, then the text; the first document follows the last (a sole document follows itself).
    Null text is empty. Repeated rows give a row each. No rows give none. Other columns are not read.

    Texts are shuffled once, to ranges of ids; the ranges come from a quantile sketch. An id (or null) that fills ranges
    of its own is cut by the hash, and its equal rows are counted before they are shuffled, so neither a hot id nor a
    hot row meets in a task. The first row of each range also goes to the range before, as its guard. The driver sees
    one id a range, no more.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    src = src.withColumn("ord", F.coalesce("id", F.lit(_LAST)))
    parts = shuffle_parts(spark)
    cuts = src.select(F.percentile_approx("ord", [k / parts for k in range(1, parts)] or [0.5], 100 * parts).alias("q")).first()["q"] or []
    ranges_of = Counter(cuts)
    hot = sorted(v for v, k in ranges_of.items() if k > 1)
    ways = {float(v): ranges_of[v] + 1 for v in hot}
    # A hot id has ranges between two cuts of its own, as many as the quantiles that it fills.
    inner = {float(x) for x in cuts} | {math.nextafter(float(v), math.inf) for v in hot}
    splits = [-math.inf, *sorted(inner or {0.0}), math.inf]
    shares = [ways.get(x, 1) for x in splits[:-1]]
    starts = [sum(shares[:k]) for k in range(len(shares))]
    src = src.withColumn("n", F.lit(1).cast("long"))
    if hot:
        tied = F.col("ord").isin(hot)
        counted = src.where(tied).groupBy("id", "ord", "body").agg(F.count("*").alias("n")).select("id", "body", "ord", "n")
        src = src.where(~tied).unionByName(counted)
    ranged = Bucketizer(splits=splits, inputCol="at", outputCol="b").transform(src.withColumn("at", F.col("ord").cast("double"))).withColumn("b", F.col("b").cast("int"))
    h = F.xxhash64("body")
    ranged = ranged.withColumn("h", h).withColumn("bucket", F.col("b"))
    if hot:
        of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("b"))
        value = of([next((v for v in hot if float(v) == x), None) for x in splits[:-1]])  # ids beyond 2^53 can share a double
        share = F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * of(shares)).cast("int"), of(shares) - 1)
        share = F.when(F.col("ord") < value, 0).when(F.col("ord") > value, of(shares) - 1).otherwise(share)
        ranged = ranged.withColumn("bucket", of(starts) + share)
    ranged = ranged.select("bucket", F.lit(False).alias("guard"), "id", "body", "n", "ord", "h")
    firsts = sorted((r["bucket"], r["least"]["ord"], r["least"]["h"]) for r in ranged.groupBy("bucket").agg(F.min(F.struct("ord", "h")).alias("least")).collect())
    nexts = [(firsts[k][0], *firsts[(k + 1) % len(firsts)][1:]) for k in range(len(firsts))]
    to = F.broadcast(spark.createDataFrame(nexts, "bucket int, ord long, h long"))  # a row a range
    guards = ranged.drop("bucket", "guard").join(to, ["ord", "h"]).select("bucket", F.lit(True).alias("guard"), "id", "body", "n", "ord", "h")
    dealt = ranged.union(guards).repartitionById(starts[-1] + shares[-1], F.col("bucket")).sortWithinPartitions("bucket", "guard", "ord", "h", "body")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long, times int"
    out = dealt.drop("ord", "h").mapInArrow(_neighbours, schema)
    if hot:
        out = out.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return out.drop("times")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
