"""Exact top-k inner products by a three-phase uniform threshold.

The components are cut into `LISTS` groups; each is a list that scores every candidate by its part of the inner product.
1. Each group of candidates gives, for each query, the best entries of every list, and the whole scores of these alone.
2. The k-th best score gathered is a safe cutoff for the query, as k rows reach it. A row can reach it only if one of its
parts reaches the cutoff over the number of lists; these entries of the lists are sufficient.
3. Only their scores are resolved, by adding up their parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.common import cut, shuffle_parts, table

LISTS = 4
#: Components of a group of candidates, which a task holds (16 MB), and of one that is worth a task; queries at a time.
GROUP, LEAST_GROUP, QUERIES = 1 << 21, 1 << 17, 256
_LOW, _HIGH = -(2**63), 2**63 - 1


def list_parts(q: np.ndarray, c: np.ndarray, lists: int) -> list[np.ndarray]:
    """Score parts by list, [queries, candidates]. Exact: doubles while no sum can pass 2^53, Python's integers else."""
    dim = q.shape[1]
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, dim)
    if not bound < 2**53:
        whole = np.frompyfunc(int, 1, 1)
        q, c = whole(q), whole(c)
    edges = [dim * k // lists for k in range(lists + 1)]
    return [q[:, a:b] @ c[:, a:b].T for a, b in zip(edges, edges[1:], strict=False)]


def gather(parts: list[np.ndarray], others: np.ndarray, k: int) -> list[np.ndarray]:
    """Phase 1: for each query the places that are among the k best of a list."""
    rows = len(others)
    found = []
    for p in parts:
        p = np.where(others, p, -np.inf) if p.dtype != object else np.where(others, p, -(2**200))
        if p.shape[1] > k:
            found.append(np.argpartition(-p, k, axis=1)[:, :k] if p.dtype != object else np.argsort(-p, axis=1)[:, :k])
        else:
            found.append(np.tile(np.arange(p.shape[1]), (rows, 1)))
    every = np.concatenate(found, axis=1)
    return [(u := np.unique(every[j]))[others[j, u]] for j in range(rows)]


def list_norms(v: np.ndarray, lists: int) -> np.ndarray:
    """Euclidean norms by list, [vectors, lists]."""
    dim = v.shape[1]
    edges = [dim * k // lists for k in range(lists + 1)]
    return np.stack([np.sqrt(np.square(v[:, a:b].astype(np.float64)).sum(axis=1)) for a, b in zip(edges, edges[1:], strict=False)], axis=1)


def sufficient(parts: list[np.ndarray], others: np.ndarray, cutoffs: np.ndarray, q_norms: np.ndarray, c_norms: np.ndarray) -> list[np.ndarray]:
    """Phase 2: for each query the places of which a list has a part of the cutoff over the number of lists or more, from
    which the other lists' norms leave the cutoff in reach."""
    huge = parts[0].dtype == object
    least = np.array([int(x) for x in cutoffs], object)[:, None] if huge else cutoffs.astype(np.float64)[:, None]
    enough = np.repeat(cutoffs[:, None] == _LOW, others.shape[1], axis=1)  # fewer rows than k: all are wanted
    most = q_norms @ c_norms.T
    for g, p in enumerate(parts):
        found = (p * len(parts) >= least).astype(bool)
        if not huge:
            rest = (most - np.outer(q_norms[:, g], c_norms[:, g])) * (1 + 1e-9) + 1
            found &= p + rest >= least
        enough |= found
    enough &= others
    return [np.flatnonzero(x) for x in enough]


def resolve(parts: list[np.ndarray], j: int, at: np.ndarray) -> np.ndarray:
    """Phase 3: whole scores of query j at some places, cut to the range of a long."""
    s = sum((p[j, at] for p in parts[1:]), parts[0][j, at])
    return np.array([min(_HIGH, max(_LOW, int(x))) for x in s], np.int64) if s.dtype == object else s.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to smaller ids."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], ~scores[at]))[:k]]


class _Group:
    """The candidates of a group, by id."""

    def __init__(self, ids: list[np.ndarray], vecs: list[np.ndarray]) -> None:
        self.ids, self.vecs = np.concatenate(ids), np.concatenate(vecs)
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.vecs = self.ids[order], self.vecs[order]
        self.lists = max(1, min(LISTS, self.vecs.shape[1]))
        self.norms = list_norms(self.vecs, self.lists)

    def answers(self, qids: np.ndarray, q: np.ndarray, cutoffs: np.ndarray | None, k: int):
        """(query ids, ids, scores) of the k best candidates that this phase has an eye on."""
        others = np.ones((len(qids), len(self.ids)), bool)
        for j, (a, b) in enumerate(zip(np.searchsorted(self.ids, qids), np.searchsorted(self.ids, qids, "right"), strict=True)):
            others[j, a:b] = False
        parts = list_parts(q, self.vecs, self.lists)
        places = gather(parts, others, k) if cutoffs is None else sufficient(parts, others, cutoffs, list_norms(q, self.lists), self.norms)
        out = [[], [], []]
        for j, at in enumerate(places):
            scores = resolve(parts, j, at)
            if cutoffs is not None:
                at, scores = at[scores >= cutoffs[j]], scores[scores >= cutoffs[j]]
            best = _best(scores, self.ids[at], k)
            for x, y in zip(out, (np.full(len(best), qids[j]), self.ids[at[best]], scores[best]), strict=True):
                x.append(y)
        return [np.concatenate(x).astype(np.int64) for x in out]


def _run(k: int, scale: float, with_cutoff: bool):
    def run(batches):
        at, ids, vecs, group = None, [], [], None
        for batch in batches:
            dims, groups, kinds, of = (batch.column(i).to_numpy() for i in range(4))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(dims)])
            cutoffs = batch.column(5).fill_null(_LOW).to_numpy()
            key = np.stack([dims, groups, kinds])
            steps = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(steps, steps[1:], strict=False):
                if a == b:
                    continue
                if at != (dims[a], groups[a]):
                    at, ids, vecs, group = (dims[a], groups[a]), [], [], None
                block = np.floor(flat[ends[a] : ends[b]].astype(np.float64) * scale).reshape(b - a, dims[a])
                if not kinds[a]:
                    ids.append(of[a:b])
                    vecs.append(block)
                    continue
                if group is None and ids:
                    group, ids, vecs = _Group(ids, vecs), [], []
                for x in range(a, b, QUERIES) if group is not None else ():
                    y = min(b, x + QUERIES)
                    found = group.answers(of[x:y], block[x - a : y - a], cutoffs[x:y] if with_cutoff else None, k)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k rows of greatest integer inner product for each query row, as (query_id, rank, vec_id, score).

    `is_query`: a condition on the rows. Components become floor(scale * x). A row is no answer to a query of its own
    id. All are returned where there are fewer than k. Ties go to the smaller id.

    Null ids, null vectors and vectors with a null or non-finite component (scaled or not) take no part. Only vectors of the same
    length are compared (empty ones score 0 with each other). Of rows with a query's id, the least vector asks; as
    answers, repeated rows are rows of their own. Scores beyond a long are cut to its range. No rows: no rows. Other
    columns are not read, and their names don't matter.

    Candidates are dealt to groups of bounded size, once a phase, and the queries (not the candidates) are copied to
    each group: a task holds a group and lets the queries pass by. No side is broadcast. What a group sends on is k
    entries a query at most, and a query's cutoff is joined to it by its id.
    """
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumn("dim", F.size("vec"))
    queries = rows.where("asks").groupBy("id", "dim").agg(F.min("vec").alias("vec"))
    size = rows.agg(F.sum("dim")).first()[0] or 0
    many = max(1, -(-size // GROUP), min(shuffle_parts(vectors.sparkSession), -(-size // LEAST_GROUP)))
    # Rows of equal ids and vectors part by the input partition that they stand in.
    group = F.pmod(F.xxhash64("id", "vec", F.spark_partition_id()), F.lit(many))
    cand = rows.select("dim", group.alias("c"), F.lit(0).alias("kind"), "id", "vec", F.lit(None).cast("long").alias("cutoff"))

    def phase(asked: DataFrame, with_cutoff: bool) -> DataFrame:
        copies = asked.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("c"), F.lit(1).alias("kind"), "id", "vec", "cutoff")
        dealt = cand.unionByName(copies).repartition(many, "dim", "c").sortWithinPartitions("dim", "c", "kind")
        local = dealt.mapInArrow(_run(k, scale, with_cutoff), "query_id long, vec_id long, score long")
        ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        return ranked.where(F.col("rank") <= k)

    gathered = phase(queries.withColumn("cutoff", F.lit(None).cast("long")), with_cutoff=False)
    cutoffs = cut(gathered.where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff")))
    asked = queries.join(cutoffs, F.col("id") == F.col("query_id"), "left").drop("query_id")
    return phase(asked, with_cutoff=True).select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
