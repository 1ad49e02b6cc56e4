"""Interaction audit of document filters: per-part counts by which filters fail, contracted for every order and step.

Each document fails some of five filters. A part's documents are counted in a 2x2x2x2x2 tensor with an axis a filter
(0: passes, 1: fails). What a filter removes at a step of an order is that tensor with `pass` selected along the axes of
the filters before it, `fail` along its own and `all` along those after it: one einsum works out all steps of all orders.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import STRIP, cut, table

FILTERS = "ABCDE"
#: Filters' bounds: words, percent of distinct words, percent of capitals; and what D looks for.
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_failures(body: Column) -> list[Column]:
    """Conditions A to D on a text that isn't null."""
    bare = F.btrim(body, F.lit(STRIP))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    n, kinds = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    return [n < MIN_WORDS, F.lit(100) * kinds < F.lit(DISTINCT_PERCENT) * n, F.lit(100) * capitals > F.lit(CAPITAL_PERCENT) * F.length(body), body.rlike(SYMBOLS)]


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, docs, good, toxic): documents of a part by the set of filters that they fail (bit k: filter k).

    Ids, hashes and masks are shuffled, never texts. Rows meet by (id, hash of the text), so neither a text with many
    copies nor a part with many documents is a hot key; the smallest id of a text is found by partial aggregation.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(body))), F.lit(0))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.unhex(F.md5(body)).alias("key"), mask.alias("mask"))
    rows = cut(light.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("n")))
    least = rows.groupBy(F.col("key").alias("text")).agg(F.min("id").alias("first"))
    lab = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc"))
    lab = cut(lab.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    seen = rows.join(cut(least).hint("merge"), (F.col("id") == F.col("first")) & (F.col("key") == F.col("text")), "left")
    seen = seen.withColumn("mask", F.when(F.col("id").isNull() | F.col("first").isNotNull(), F.col("mask")).otherwise(F.col("mask") + (1 << 4)))
    seen = seen.select("id", "part", "mask", "n").join(lab.hint("merge"), F.col("id") == F.col("doc"), "left")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return seen.groupBy("part", "mask").agg(F.sum("n").alias("docs"), of("good"), of("toxic"))


def audit_tensors(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts [parts, orders, steps] of the audit, from tensors [parts, 3, 2, ..., 2] of all, good and toxic documents."""
    k = counts.ndim - 2
    orders = list(permutations(range(k)))
    place = np.argsort(orders, axis=1)  # place[o, f]: step of filter f in order o
    step = np.arange(k)[None, :, None]
    before, own = place[:, None, :] < step, place[:, None, :] == step
    picks = np.array([ALL, PASS, FAIL], np.int64)
    contract = lambda which: np.einsum(counts, [0, 1, *range(2, 2 + k)], *[x for f in range(k) for x in (picks[which[..., f]], [2 + k, 3 + k, 2 + f])], [0, 1, 2 + k, 3 + k], optimize="greedy")
    removed = contract(np.where(before, 1, np.where(own, 2, 0)))
    kept = contract(np.where(before | own, 1, 0))[:, 0]
    fails = contract(np.where(own, 2, 0) + np.zeros_like(place[:, None, :]))[:, 0]
    alone = contract(np.where(own, 2, 1) + np.zeros_like(place[:, None, :]))[:, 0]
    filters = np.broadcast_to(np.array(orders), kept.shape)
    by_filter = np.zeros((len(counts), k), np.int64)
    for f in range(k):
        by_filter[:, f] = np.where(filters == f, removed[:, 0], 0).sum(axis=(1, 2))
    shapley = np.take_along_axis(by_filter, filters.reshape(len(counts), -1), axis=1).reshape(kept.shape)
    return {"kept": kept, "removed": removed[:, 0], "redundant": fails - removed[:, 0], "unique_fails": alone, "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": shapley}


def _contract(filters: str):
    orders, k = ["".join(o) for o in permutations(filters)], len(filters)
    rows = len(orders) * k

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                parts, cells = batch.column(0), batch.column(1)
                of = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy())
                flat = cells.flatten()
                tensor = np.zeros((batch.num_rows, 3, 2**k), np.int64)
                for j, name in enumerate(("docs", "good", "toxic")):
                    np.add.at(tensor[:, j], (of, flat.field("mask").to_numpy()), flat.field(name).to_numpy())
                # Bit f of a mask is filter f, so the last axis of the plain reshape is the first filter.
                cube = tensor.reshape(batch.num_rows, 3, *[2] * k).transpose(0, 1, *range(k + 1, 1, -1))
                got = audit_tensors(np.ascontiguousarray(cube))
                many = batch.num_rows
                names = np.tile(np.repeat(orders, k), many)
                yield pa.RecordBatch.from_arrays(
                    [parts.take(pa.array(np.repeat(np.arange(many), rows))), pa.array(names), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many * len(orders))), *[pa.array(got[c].reshape(-1)) for c in COUNTS]],
                    ["part", "filter_order", "step", *COUNTS],
                )

    return run


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley), all longs but the first three.

    Filters by letter: A, under 200 words (runs of what isn't ASCII white space, case counts); B, less than half of the
    words distinct; C, more than 2 % of the code points `A` to `Z`; D, one of `#$%&*|`; E, the text of a smaller id, in
    any part. `shapley` is what the step's filter removes, summed over all orders.

    Null or empty text: an empty text, which fails A, and E if a smaller id has one too. Null part: the part ''. Null
    ids have no smaller id, are none, and have no labels. Rows of the same id and text don't fail E against each
    other, and each counts. An id with several labels is good (toxic) if one says so. No documents: no rows; no labels:
    nothing is lost. Other columns are not read, and their names don't matter.

    A part gives 32 counts at most, whatever its documents; a task of the contraction holds 64 parts.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(part_col).alias("source"))
    labels = labels.select(F.col(id_col).alias("doc_id"), "quality", "toxic")
    cells = failure_counts(docs, labels, "doc_id", "text", "source").groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("cells"))
    return cells.mapInArrow(_contract(FILTERS), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_interactions(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
                      regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT body AS t, min(doc_id) AS first FROM words GROUP BY body),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body),
                regexp_matches(body, '[#$%&*|]'), coalesce(words.doc_id > first, false)] AS f, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words JOIN firsts ON body = t LEFT JOIN lab ON words.doc_id = lab.doc_id),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, f),
k AS (SELECT unnest(range(1, 6)) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM k a, k b, k c, k d, k e
           WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, i AS step, o[i] AS own, o[1:i - 1] AS before FROM orders, k),
told AS (
  SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', CAST(x AS INTEGER), 1)), '') AS filter_order, step, own,
         sum(n) FILTER (NOT f[own] AND NOT earlier) AS kept, sum(n) FILTER (f[own] AND NOT earlier) AS removed,
         sum(n) FILTER (f[own] AND earlier) AS redundant, sum(n) FILTER (f[own] AND fails = 1) AS unique_fails,
         sum(good) FILTER (f[own] AND NOT earlier) AS good_lost, sum(toxic) FILTER (f[own] AND NOT earlier) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda x: f[x])) > 0 AS earlier, len(list_filter(f, lambda x: x)) AS fails FROM masks, steps)
  GROUP BY part, o, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM told
"""
