"""URL filter: rules by host and path, else the ratio of two character language models. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import cut, let, table
from emberwatch.llm.line_dedup import LOWER, UPPER

#: Host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Characters of the longest gram (context and next character).
ORDER = 5
#: Grams with this part of all characters or more are broadcast.
HOT = 5000
#: Calibration: scores are counted in steps of 1 / STEPS, between -REACH and REACH.
STEPS, REACH = 100, 2.0
START = "\x02"


def host_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _windows(text: Column) -> Column:
    """For each character, the gram of ORDER characters that ends with it. Long texts cost in proportion."""
    chars = F.concat(F.array_repeat(F.lit(START), ORDER - 1), F.filter(F.split(text, ""), lambda c: c != ""))

    def grams(of: Column) -> Column:
        at = F.when(F.size(of) >= ORDER, F.sequence(F.lit(ORDER - 1), F.size(of) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.get(of, i - k) for k in reversed(range(ORDER))]))

    return let(chars, grams)


def levels(texts: DataFrame) -> list[DataFrame]:
    """(g, n, v) by length of the gram, from (body, good): how often the gram occurs in the texts, and the log ratio of
    the Witten-Bell models of the accepted and of the rejected texts. Texts whose `good` is null train neither model,
    but their grams get a row as well.

    P(x | c) = (N(cx) + T(c) P(x | c')) / (N(c) + T(c)), with T(c) the kinds of characters seen after c and c' the
    context without its first character; below the empty context every character is as likely as another. A gram that a
    class lacks has N(cx) = 0 there: the shorter gram's P times the weight of the context's escape, T / (N + T).
    """
    ends = texts.select("good", F.explode(_windows(F.col("body"))).alias("w"))
    ends = ends.groupBy("w").agg(F.count_if("good").cast("double").alias("n1"), F.count_if(~F.col("good")).cast("double").alias("n0"), F.count("*").alias("n"))
    suffixes = F.array(*[F.expr(f"substring(w, {ORDER - k + 1})") for k in range(1, ORDER + 1)])
    grams = ends.select("n1", "n0", "n", F.explode(suffixes).alias("g"))
    counts = cut(grams.groupBy("g").agg(*[F.sum(n).alias(n) for n in ("n1", "n0", "n")]).withColumn("k", F.length("g")))
    context = F.expr("substring(g, 1, k - 1)")
    stats = counts.groupBy(context.alias("c"), F.col("k").alias("ck")).agg(*[f for y in "01" for f in (F.sum(f"n{y}").alias(f"s{y}"), F.count_if(F.col(f"n{y}") > 0).cast("double").alias(f"t{y}"))])
    joined = counts.join(stats, (context == F.col("c")) & (F.col("k") == F.col("ck")))
    kinds = F.greatest(F.lit(1), F.lit(counts.where("k = 1 AND n0 + n1 > 0").count()))
    below, out = None, []
    for k in range(1, ORDER + 1):
        level = joined.where(F.col("k") == k)
        if below is None:
            level = level.withColumns({f"b{y}": 1.0 / kinds for y in "01"})
        else:
            level = level.withColumn("suffix", F.expr("substring(g, 2)")).join(below, "suffix")
        p = {f"p{y}": F.when(F.col(f"s{y}") > 0, (F.col(f"n{y}") + F.col(f"t{y}") * F.col(f"b{y}")) / (F.col(f"s{y}") + F.col(f"t{y}"))).otherwise(F.col(f"b{y}")) for y in "01"}
        level = level.withColumns(p)
        out.append(level.select("g", "n", (F.log("p1") - F.log("p0")).alias("v")))
        below = level.select(F.col("g").alias("suffix"), F.col("p0").alias("b0"), F.col("p1").alias("b1"))
    return out


def train(labelled: DataFrame) -> DataFrame:
    """The log ratios of all grams of (body, good), of 1 to ORDER characters. See `levels`."""
    return reduce(DataFrame.unionByName, levels(labelled))


def score(texts: DataFrame, model: DataFrame, body: str = "body") -> DataFrame:
    """`texts`, which `row` identifies, with `score`: the mean over the characters of `body` of the model's ratios; 0 for
    an empty text. `model` is the last of the `levels` of a corpus that holds the texts, cut.

    Characters meet their grams by a join. Grams with a share of 1 / HOT of all characters or more, which are HOT of
    them at most, are broadcast and their characters stay in the task; so no key of the shuffle has more than that.
    """
    total = model.agg(F.sum("n")).scalar()
    is_hot = F.col("n") * HOT >= total
    ends = texts.select("row", F.explode(_windows(F.col(body))).alias("g"))
    ends = ends.join(F.broadcast(model.where(is_hot).select("g", "v")), "g", "left")
    hot = ends.where(F.col("v").isNotNull()).select("row", "v")
    rest = ends.where(F.col("v").isNull()).select("row", "g").join(model.where(~is_hot).select("g", "v"), "g").select("row", "v")
    means = hot.unionByName(rest).groupBy("row").agg(F.avg("v").alias("score"))
    return texts.join(means, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def calibrate(scored: DataFrame) -> DataFrame:
    """One row, `threshold`: the step that parts (score, good) best, by the mean of both classes' accuracies; of
    equals the one nearest to 0; 0 where a class is absent."""
    step = F.round(F.least(F.greatest(F.col("score"), F.lit(-REACH)), F.lit(REACH)) * STEPS).cast("int")
    bins = scored.groupBy(step.alias("b")).agg(F.count_if("good").alias("n1"), F.count_if(~F.col("good")).alias("n0"))
    whole = bins.agg(F.coalesce(F.collect_list(F.struct("b", "n1", "n0")), F.array()).alias("bins"))  # a few hundred at most
    total = lambda name, keep: F.aggregate(F.filter("bins", keep), F.lit(0.0), lambda a, x: a + x[name])
    always = lambda x: F.lit(True)
    good, bad = total("n1", always), total("n0", always)
    tried = F.transform("bins", lambda t: F.struct((total("n1", lambda x: x["b"] >= t["b"]) / good + total("n0", lambda x: x["b"] < t["b"]) / bad).alias("right"), (-F.abs(t["b"])).alias("near"), t["b"].alias("b")))
    return whole.select(F.when((good > 0) & (bad > 0), F.array_max(tried)["b"] / STEPS).otherwise(0.0).cast("double").alias("threshold"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(`id_col`, host, path, rule, verdict, score) a row.

    The rules' verdicts label the urls they fit. Four fifths of these, by crc32 of the url, train the two models; the
    rest calibrates the threshold of the length-normalised log-likelihood difference. Urls that no rule fits are
    judged by it: allow from the threshold on. `score` is that difference, of all urls. The models see what follows
    the first `://` (the whole where there is none), A-Z lower-cased.

    Null or empty url: host and path empty, score 0. Null ids and repeated rows are kept as they are; repeated urls
    count as often as they occur. With no labelled url of one class, all that no rule fits is allowed. No rows: no
    rows. Other columns are not read. The model has a row for each gram of the urls, and grows with them.
    """
    host, path = host_path(F.col("url"))
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)\A.*?://", "")
    src = src.withColumns({"rule": rule, "ruled": verdict, "body": F.translate(rest, UPPER, LOWER), "held_out": F.crc32("url") % 5 == 0})
    src = cut(src.drop("url").withColumn("row", F.monotonically_increasing_id()))
    good = F.col("ruled") == "allow"
    model = cut(levels(src.select("body", F.when(~F.col("held_out"), good).alias("good")))[-1])
    judged = cut(score(src, model).drop("body", "row"))
    labelled = judged.where(F.col("held_out") & F.col("ruled").isNotNull()).select("score", good.alias("good"))
    threshold = cut(calibrate(labelled)).scalar()
    own = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
