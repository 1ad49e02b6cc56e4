"""Joins of points with the ranges that hold them, and of texts with the fragments that they contain, by equality alone.

A plain join on a group (a package's name) meets every point of the group with every range of it. Here the bounds of a
group are sorted once, every point gets its slot between them, and a range becomes a few nodes of a binary tree over the
slots: a point lies in a range exactly if one of its own nodes, one a level, is among the range's. So the join is an
equi-join whose rows are the pairs that hold, and what is shuffled grows by a logarithm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberwatch.sources.shared import cut

#: Levels of points without a key, and of ranges that hold all points that have one.
_NO_KEY, _ALL = -1, -2
#: Ranges up to which a table of them is broadcast, and each is judged at the points of its group.
FEW = 256


def _shift(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, bits)


def _runs(bounds: str, holds: Callable[[Column], Column]) -> Column:
    """Runs [lo, hi) of the cells of sorted `bounds` in which `holds`: cell 0 precedes the first bound, 2k + 1 is bound k,
    and 2k + 2 lies behind it. A cell is judged at one of its points; the least string behind a bound ends with a zero."""
    cells = F.sequence(F.lit(0), F.size(bounds) * 2)
    at = lambda c: F.when(c == 0, F.lit("")).when(c % 2 == 1, F.get(bounds, (c / 2).cast("int"))).otherwise(F.concat(F.get(bounds, (c / 2).cast("int") - 1), F.lit("\x00")))
    judged = F.transform(cells, lambda c: F.struct(c.alias("cell"), F.coalesce(holds(at(c)), F.lit(False)).alias("on")))

    def step(state: Column, x: Column) -> Column:
        """Opens a run where none is open, and ends it at the first cell that doesn't hold."""
        opens = F.when(x["on"] & (state["lo"] < 0), x["cell"]).when(~x["on"], F.lit(-1)).otherwise(state["lo"])
        ended = F.when(~x["on"] & (state["lo"] >= 0), F.array(F.struct(state["lo"].alias("lo"), x["cell"].alias("hi")))).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))
        return F.struct(opens.alias("lo"), F.concat(state["runs"], ended).alias("runs"))

    start = F.struct(F.lit(-1).alias("lo"), F.array().cast("array<struct<lo:int,hi:int>>").alias("runs"))
    last = lambda s: F.when(s["lo"] >= 0, F.concat(s["runs"], F.array(F.struct(s["lo"].alias("lo"), (F.size(bounds) * 2 + 1).alias("hi"))))).otherwise(s["runs"])
    return F.aggregate(judged, start, step, last)


def stabbed(points: DataFrame, ranges: DataFrame, group: list[str], bounds: Column, holds: Callable[[Column], Column], carry: list[str], few: int = FEW) -> DataFrame:
    """(`group`, key, `carry`) for each distinct point (`group`, key) and each row of `ranges` for which `holds(key)`.

    `bounds`: the array of keys at which `holds` may change, as strings whose order is the keys' order. A point's key may
    be null, and is judged as such. Rows of `ranges` that hold a point in several ways come once for each run of theirs,
    which are disjoint, so once a point. `few` ranges or fewer are broadcast. Of more, one window sorts the distinct keys of
    a group, and all joins are equi-joins on checkpointed sides, which adaptive execution can split."""
    ranges, points = cut(ranges), points.select(*group, "key").distinct()
    if ranges.limit(few + 1).count() <= few:
        return points.join(F.broadcast(ranges), group).where(F.coalesce(holds(F.col("key")), F.lit(False))).select(*group, "key", *carry)
    r = ranges.withColumns({"_k": F.array_sort(F.array_distinct(F.array_compact(bounds))), "_null": F.coalesce(holds(F.lit(None).cast("string")), F.lit(False))})
    r = r.withColumn("_runs", _runs("_k", holds)).select(*group, *carry, "_k", "_null", "_runs")
    marks = r.select(*group, F.explode("_k").alias("key"), F.lit(1).alias("b")).unionByName(points.where("key IS NOT NULL").withColumn("b", F.lit(0)))
    w = Window.partitionBy(*group)
    marks = marks.groupBy(*group, "key").agg(F.max("b").cast("long").alias("b"), F.min("b").alias("least"))
    before = F.coalesce(F.sum("b").over(w.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = cut(marks.withColumns({"below": before, "total": F.sum("b").over(w)}).withColumn("levels", F.length(F.bin(F.col("total") * 2 + 1))))

    place = lambda c: F.get("_k", ((c + 1) / 2).cast("int") - 1)
    off = lambda c: F.when(c % 2 == 1, 1).otherwise(2)
    lo, hi = F.col("run.lo"), F.col("run.hi")
    runs = r.select(*group, *carry, F.explode("_runs").alias("run"), "_k").withColumns({"lo_key": F.when(lo > 0, place(lo)), "hi_key": F.when(hi <= F.size("_k") * 2, place(hi)), "lo_off": off(lo), "hi_off": off(hi)})
    runs = runs.select(*group, *carry, "lo_key", "hi_key", "lo_off", "hi_off")
    for side in ("lo", "hi"):
        known = index.select(*group, F.col("key").alias(f"{side}_key"), F.col("below").alias(f"{side}_below"), F.col("total").alias(f"{side}_total"), F.col("levels").alias(f"{side}_levels"))
        runs = runs.join(known, [*group, f"{side}_key"], "left")
    a = F.when(F.col("lo_key").isNull(), F.lit(0)).otherwise(F.col("lo_below") * 2 + F.col("lo_off")).cast("long")
    b = F.when(F.col("hi_key").isNull(), F.col("lo_total") * 2 + 1).otherwise(F.col("hi_below") * 2 + F.col("hi_off")).cast("long")
    runs = runs.withColumns({"a": a, "b": b, "levels": F.coalesce("lo_levels", "hi_levels")})

    def nodes_at(level: Column) -> Column:
        left, right = _shift(F.col("a") + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level), _shift(F.col("b"), level)
        node = lambda at: F.struct(level.cast("int").alias("level"), at.alias("at"))
        return F.when(left < right, F.array_compact(F.array(F.when(left % 2 == 1, node(left)), F.when(right % 2 == 1, node(right - 1)))))

    tree = F.flatten(F.array_compact(F.transform(F.sequence(F.lit(0), F.col("levels")), nodes_at)))
    every = F.array(F.struct(F.lit(_ALL).alias("level"), F.lit(0).cast("long").alias("at")))
    held = runs.select(*group, *carry, F.explode(F.when(F.col("lo_key").isNull() & F.col("hi_key").isNull(), every).otherwise(tree)).alias("node"))
    unkeyed = F.struct(F.lit(_NO_KEY).alias("level"), F.lit(0).cast("long").alias("at"))
    held = held.unionByName(r.where("_null").select(*group, *carry, unkeyed.alias("node")))

    slot = (F.col("below") * 2 + F.col("b")).cast("long")
    own = F.transform(F.sequence(F.lit(0), F.col("levels")), lambda level: F.struct(level.cast("int").alias("level"), _shift(slot, level).alias("at")))
    mine = index.where("least = 0").select(*group, "key", F.explode(F.concat(own, every)).alias("node"))
    mine = mine.unionByName(points.where("key IS NULL").select(*group, "key", unkeyed.alias("node")))
    flat = lambda df, *cols: df.select(*group, F.col("node.level").alias("_level"), F.col("node.at").alias("_at"), *cols)
    return flat(mine, "key").join(flat(held, *carry), [*group, "_level", "_at"]).select(*group, "key", *carry)


def fragments(text: Column, size: int) -> Column:
    """Distinct fragments of `size` characters."""
    if size == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, needles: DataFrame, size: int = 3) -> DataFrame:
    """(text, needle) for each text that contains a needle.

    A needle waits under its rarest fragment of `size` characters, by the number of texts that have it, and meets only the
    texts that have that one; where no text has one of its fragments, none contains it. Shorter needles are fragments of
    their own length, and meet the texts that have them. Nulls take no part."""
    texts, needles = cut(texts.select("text").where("text IS NOT NULL").distinct()), needles.select("needle").where("needle IS NOT NULL").distinct()
    parts = texts.select("text", F.explode(fragments(F.col("text"), size)).alias("gram"))
    counts = parts.groupBy("gram").agg(F.count("*").alias("n"))
    grams = needles.where(F.length("needle") >= size).select("needle", F.explode(fragments(F.col("needle"), size)).alias("gram"))
    rarest = grams.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0")
    waits = cut(rarest.select("needle", F.col("r.gram").alias("gram")))
    out = parts.join(waits, "gram").where(F.contains("text", "needle")).select("text", "needle")
    short = cut(needles.where(F.length("needle") < size).select("needle", F.length("needle").alias("length")))
    for length in sorted(r["length"] for r in short.select("length").distinct().collect()):  # fewer than `size`
        of = texts.select("text", F.explode(fragments(F.col("text"), length)).alias("needle"))
        out = out.unionByName(of.join(short.where(F.col("length") == length).select("needle"), "needle").select("text", "needle"))
    return out
