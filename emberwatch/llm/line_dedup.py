"""Exact line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import STRIP, cut, fresh, let, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends and with A-Z (only these) lower-cased."""
    bare = F.btrim(line, F.lit(STRIP))
    # translate() works code point by code point; plain ASCII takes the vectorised lower().
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that at least `min_docs` documents hold, except in the holder with the largest id.

    Returns the columns of `docs` with the text replaced, and then `n_lines` (before) and `n_dropped` (longs; with `_` before
    their names where `docs` has such columns, whatever their case). Only keys of `min_chars` code points or more count.

    Null or empty text: one empty line, which stays. Rows of the same id are one document; those that tie for the
    largest id all keep the line. Rows of null id are a document each, and never the largest; where all holders have
    none, all keep the line. No rows: no rows. Other columns pass through, whatever their names. A text costs time in
    proportion to its length.

    The counts shuffle a 16-byte hash a line and combine map-side, so a line of every document is no hot spot;
    the hits join meets checkpointed keys, which lets adaptive execution split a hot line. Whole texts are
    shuffled once, by id and text, and meet checkpointed hits, so that equal rows, however many, are split as well.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    added = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("body"),
        F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("rest"),
    ).withColumn("rk", F.xxhash64("id", "body"))
    lines = F.split("body", "\n", -1)

    keys = F.transform(lines, line_key)
    # Distinct over strings takes a hash set; over binaries every element would meet every other.
    once = F.array_distinct(F.transform(F.filter(keys, lambda k: F.length(k) >= min_chars), F.md5))
    held = base.select("id", F.explode(once).alias("hex")).select("id", F.unhex("hex").alias("key"))
    counts = held.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
    common = cut(counts.where(F.col("n") >= min_docs).select("key", "keeper", "n"))
    repeated = cut(base.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"))
    if not repeated.isEmpty():  # what the rows of an id count too much
        again = held.join(repeated.hint("merge"), "id").groupBy("key", "id").agg((F.count("*") - 1).alias("more"))
        again = again.groupBy("key").agg(F.sum("more").alias("more"))
        common = cut(common.join(again.hint("merge"), "key", "left").where(F.col("n") - F.coalesce("more", F.lit(0)) >= min_docs).select("key", "keeper"))
    common = common.select("key", "keeper")

    placed = base.select("id", "rk", F.posexplode(lines).alias("pos", "line")).select("id", "rk", "pos", line_key(F.col("line")).alias("k"))
    placed = placed.where(F.length("k") >= min_chars).select("id", "rk", "pos", _hash(F.col("k")).alias("key"))
    hits = (
        placed.join(common, "key")
        .where(F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("hit_id"), F.col("rk").alias("hit_rk"))
        .agg(F.collect_set("pos").alias("drops"))
    )
    joined = base.join(cut(hits), F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("rk") == F.col("hit_rk")), "left")
    stays = lambda all_lines: F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("drops"))
    rest = let(lines, lambda all_lines: F.array_join(F.transform(stays(all_lines), lambda i: F.get(all_lines, i)), "\n"))
    kept = F.when(F.col("drops").isNull(), F.col("body")).otherwise(rest)
    parts = {id_col: F.col("id"), text_col: kept} | {c: F.col(f"rest.`{c}`") for c in others}
    return joined.select(
        *[parts[c].alias(c) for c in docs.columns if c in parts],
        F.size(lines).cast("long").alias(added[0]),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias(added[1]),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i AS pos, parts[i] AS line,
         translate(regexp_replace(regexp_replace(parts[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+\z', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS u(i)),
common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
