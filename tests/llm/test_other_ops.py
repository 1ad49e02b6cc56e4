"""WARC, URL filter, language id, near-dedup, top-k and the pipeline against brute force, with their edge cases."""

import gzip
import hashlib
import math
import random
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import language_id, near_dedup, topk, url_filter, warc
from emberwatch.llm.common import shared_path

# WARC


def read_back(spark, pages):
    where = shared_path(spark, "t")
    warc.write_archives(pages, where)
    index = warc.build_index(spark, where)
    from pyspark.sql import types as T

    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("to", T.LongType()), T.StructField("url", T.StringType())])
    rows = warc.read_records(index, out, lambda h, p, r: (r["page_id"], p.decode(), r["record_type"], r["refers_to"], r["url"])).collect()
    return where, index, rows


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (5, "http://b/ü", big), (3, None, big), (2, "u\r\nX: y", "small"), (4, "u", "small"), (6, "u", None), (None, "n", big), (7, "u", "\r\n\r\n\x00x"), (8, "z", "q" * 100_000)]
    where, index, got = read_back(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    for i, _, html in rows:
        revisit = html == big and i != 5
        assert (got[i]["kind"], got[i]["to"], got[i]["payload"]) == (("revisit", 5, "") if revisit else ("response", None, html or ""))
    assert got[1]["url"] == "http://a/" and got[5]["url"] == "http://b/ü" and got[3]["url"] is None and got[2]["url"] == "u%0D%0AX: y"
    files = sorted(Path(where.removeprefix("file://")).glob("part-*"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == len(rows)
    assert index.where("payload_bytes = 1200").select("payload_digest").distinct().first()[0] == hashlib.sha1(big.encode()).hexdigest()


def test_warc_odd_tables(spark):
    schema = "page_id long, url string, html string"
    _, _, got = read_back(spark, spark.createDataFrame([], schema))
    assert got == []
    twice = spark.createDataFrame([(1, "u", "x" * 2000)] * 2 + [(0, "u", "x" * 2000)], schema)
    assert sorted((r["page_id"], r["kind"]) for r in read_back(spark, twice)[2]) == [(0, "revisit"), (1, "response"), (1, "response")]


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300_000)
    rng = random.Random(5)
    noise = lambda n: "".join(chr(rng.randrange(33, 126)) for _ in range(n))
    rows = [(k, "u", noise(rng.choice([10, 60_000, 100_000, 140_000]))) for k in range(40)] + [(99, "u", noise(500_000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    where, index, got = read_back(spark, df.withColumn("payload", F.lit("clash")).withColumn("sha", F.lit("clash")))
    assert {r["page_id"]: r["payload"] for r in got} == {i: t for i, _, t in rows}
    sizes = {r["archive"]: r["size"] for r in index.groupBy("archive").agg(F.sum("payload_bytes").alias("size")).collect()}
    assert len(sizes) > 5 and all(s <= 300_000 or s == 500_000 for s in sizes.values())


def test_warc_one_large_page_leaves_the_files_of_others(spark, monkeypatch):
    """60 pages of 1,500 bytes fill archives of 32 records, beside a page of an archive's size."""
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 64_000)
    monkeypatch.setattr(warc, "LARGE", 1_000)
    sizes = {1: 0, 2: 1000, 3: 1001, 4: 2000, 5: 2001, 6: 64_000} | {k: 1500 for k in range(10, 70)}
    pages = spark.createDataFrame([(k, f"https://e.org/{k}", chr(97 + k % 26) + str(k).zfill(5) * (n // 5) if n else "") for k, n in sizes.items()], "page_id long, url string, html string").coalesce(1)
    where = shared_path(spark, "warc-classes")
    warc.write_archives(pages, where)
    index = warc.build_index(spark, where)
    assert sorted(r["page_id"] for r in index.select("page_id").collect()) == sorted(sizes)
    assert index.select("archive").distinct().count() <= 7


def test_large_record_ends_in_zero():
    raw = warc._member(b"a" * (17 << 20))
    assert raw[-1] == 0 and [(o, n, len(x)) for o, n, x in warc.members(raw + warc._member(b"b"))] == [(0, len(raw), 17 << 20), (len(raw), len(warc._member(b"b")), 1)]


def test_coalesced_reads():
    assert warc.coalesced([0, 10, 500, 505], [10, 20, 5, 5], gap=5, most=100) == [(0, 30, 0, 2), (500, 510, 2, 4)]
    assert warc.coalesced([0, 10, 20], [10, 10, 10], gap=5, most=20) == [(0, 20, 0, 2), (20, 30, 2, 3)]
    assert warc.coalesced([], []) == []


# URLs


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[0]), default=(None, None))[0]


def test_url_rules(spark):
    urls = ["http://a.example.NET/en/x", "http://example.net/en", "http://xnet/", "http://net/", "http://net", "https://b.org/fr/?x", "ftp://b.org/fr#", "http://c.example.com/de/a?b#c", "http://example.com/de", None, "", "no scheme", "x://y://z/q", "HTTP://ÄB.Org/FR/", "http://a.net?x=/en/", "http://u\nv.net/a"]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for k, u in enumerate(urls):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == plain_rule(u), u
        assert got[k]["verdict"] in ("allow", "block")
        want = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.get(got[k]["rule"])
        assert want is None or got[k]["verdict"] == want


def test_url_odd_tables(spark):
    rows = [(None, "http://a.org/fr/x"), (1, "http://b.net/y"), (1, "http://b.net/y"), (1, "http://c.edu/" + "ab" * 50_000), (2, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    for name in ("host", "path", "rule", "verdict", "score", "row", "body", "good", "g", "id"):
        df = df.withColumn(name, F.lit("clash"))
    got = [(r["page_id"], r["host"], r["verdict"]) for r in url_filter.filter_urls(df).collect()]
    assert sorted((g[:2] for g in got), key=str) == sorted([(None, "a.org"), (1, "b.net"), (1, "b.net"), (1, "c.edu"), (2, "")], key=str)
    assert {g[1]: g[2] for g in got if g[1] in ("a.org", "b.net")} == {"a.org": "allow", "b.net": "block"}


def test_url_windows_cost_in_proportion(spark):
    url = "".join(chr(97 + k * k % 26) for k in range(300_000))
    grams = spark.createDataFrame([(url,), ("",), ("x",)], "u string").select(F.explode(url_filter._windows(F.col("u"))).alias("g"))
    start = time.time()
    assert grams.count() == 300_001 and grams.where(F.length("g") != url_filter.ORDER).count() == 0
    assert time.time() - start < 60
    padded = url_filter.START * (url_filter.ORDER - 1) + url
    assert grams.limit(50).collect() == [(padded[i : i + url_filter.ORDER],) for i in range(50)]


def test_url_model(spark):
    rng = random.Random(1)
    good = [f"http://k{rng.randrange(99)}.org/fr/garden-{rng.choice(['rose', 'tulip', 'daisy'])}-{k}" for k in range(150)]
    bad = [f"http://k{rng.randrange(99)}.net/casino-{rng.choice(['win', 'bets', 'slots'])}-{k}" for k in range(150)]
    new = [f"http://q{k}.edu/garden-rose-{k}" for k in range(20)] + [f"http://q{k}.edu/casino-slots-{k}" for k in range(20)]
    rows = list(enumerate(good + bad + new))
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    verdicts = [got[300 + k]["verdict"] for k in range(40)]
    assert verdicts == ["allow"] * 20 + ["block"] * 20
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_model_is_witten_bell(spark):
    """The ratios of a tiny corpus, worked out by hand-written recursion."""
    texts = [("abab", True), ("abc", True), ("bba", False), ("cab", False)]
    got = {r["g"]: r["v"] for r in url_filter.train(spark.createDataFrame(texts, "body string, good boolean")).collect()}
    counts, start = {True: defaultdict(int), False: defaultdict(int)}, url_filter.START
    for t, y in texts:
        padded = start * (url_filter.ORDER - 1) + t
        for i in range(url_filter.ORDER - 1, len(padded)):
            for n in range(1, url_filter.ORDER + 1):
                counts[y][padded[i - n + 1 : i + 1]] += 1
    kinds = len({g for y in counts for g in counts[y] if len(g) == 1})

    def p(y, g):
        lower = p(y, g[1:]) if len(g) > 1 else 1 / kinds
        seen = [c for h, c in counts[y].items() if len(h) == len(g) and h[:-1] == g[:-1]]
        return (counts[y].get(g, 0) + len(seen) * lower) / (sum(seen) + len(seen)) if seen else lower

    assert set(got) == set(counts[True]) | set(counts[False])
    for g, v in got.items():
        assert v == pytest.approx(math.log(p(True, g)) - math.log(p(False, g)))


def test_url_model_keeps_every_gram(spark):
    """More distinct grams than a table of 131,072 slots can hold; each is scored by its own value."""
    rng = random.Random(3)
    texts = [("".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(30)), k % 2 == 0) for k in range(5000)]
    src = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "row long, body string, good boolean")
    model = url_filter.cut(url_filter.levels(src)[-1])
    seen = {(url_filter.START * (url_filter.ORDER - 1) + t)[i : i + url_filter.ORDER] for t, _ in texts for i in range(len(t))}
    values = {r["g"]: r["v"] for r in model.collect()}
    assert len(seen) > 140_000 and set(values) == seen
    got = {r["row"]: r["score"] for r in url_filter.score(src, model).collect()}
    for k, (t, good) in enumerate(texts):
        padded = url_filter.START * (url_filter.ORDER - 1) + t
        assert got[k] == pytest.approx(sum(values[padded[i : i + url_filter.ORDER]] for i in range(len(t))) / len(t))
        assert (got[k] > 0) == good


def test_url_score_is_witten_bell(spark):
    """Scores of texts with grams and characters that one model or both lack, against hand-written recursion."""
    texts = [("abab", True), ("abc", True), ("abcab", True), ("bba", False), ("cab", False), ("abd", None), ("ccc", None), ("bab\u00e9", None), ("zz", None), ("", None)]
    src = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "row long, body string, good boolean")
    got = {r["row"]: r["score"] for r in url_filter.score(src, url_filter.cut(url_filter.levels(src)[-1])).collect()}
    counts, start = {True: defaultdict(int), False: defaultdict(int)}, url_filter.START

    def ends(t):
        padded = start * (url_filter.ORDER - 1) + t
        return [padded[i : i + url_filter.ORDER] for i in range(len(t))]

    for t, y in texts:
        for g in ends(t) if y is not None else []:
            for n in range(1, url_filter.ORDER + 1):
                counts[y][g[-n:]] += 1
    kinds = len({g for y in counts for g in counts[y] if len(g) == 1})

    def p(y, g):
        lower = p(y, g[1:]) if len(g) > 1 else 1 / kinds
        seen = [c for h, c in counts[y].items() if len(h) == len(g) and h[:-1] == g[:-1]]
        return (counts[y].get(g, 0) + len(seen) * lower) / (sum(seen) + len(seen)) if seen else lower

    for k, (t, _) in enumerate(texts):
        want = [math.log(p(True, g)) - math.log(p(False, g)) for g in ends(t)]
        assert got[k] == pytest.approx(sum(want) / len(want) if want else 0.0), t


# Language


def test_gradients():
    net = language_id.Network(3, hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, lengths, y = rng.integers(97, 101, (6, 4)).astype(np.uint8), np.array([6, 4, 1, 6]), np.array([0, 1, 2, 1])
    _, grad = net.gradients(x, lengths, y)
    for name, g in grad.items():
        for at in list(zip(*np.nonzero(np.abs(g) > 1e-6)))[:12]:
            value, eps = net.p[name][at], 1e-3
            net.p[name][at] = value + eps
            up = net.gradients(x, lengths, y)[0]
            net.p[name][at] = value - eps
            down = net.gradients(x, lengths, y)[0]
            net.p[name][at] = value
            assert g[at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=2e-4), (name, at)


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    langs, net = language_id.learn(docs)
    german = docs.where(language_id.held_out() & (F.col("lang") == "de") & (F.length("text") > 100)).orderBy("doc_id").first()["text"]
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "123 !?"), (3, "x"), (4, german * (300_000 // len(german)))], "doc_id long, text string")
    clash = odd.withColumns({c: F.lit("old") for c in ("Score", "HAS_LETTER", "LANG_PRED")})
    told = language_id.predict_languages(clash, langs, net)
    assert told.columns == [*clash.columns, "_lang_pred", "_score"] and told.where("Score <> 'old' OR HAS_LETTER <> 'old' OR LANG_PRED <> 'old'").isEmpty()
    got = {r["doc_id"]: r for r in language_id.predict_languages(odd, langs, net).collect()}
    assert [got[i]["lang_pred"] for i in (None, 1, 2)] == ["und"] * 3 and got[1]["score"] == 0.0
    assert got[3]["lang_pred"] in langs and got[4]["lang_pred"] == "de" and 0 < got[4]["score"] <= 1
    out = language_id.predict_languages(docs, langs, net).where(language_id.held_out() & (F.length("text") > 100))
    right = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.9
    assert language_id.predict_languages(odd.limit(0), langs, net).count() == 0
    none, blank = language_id.learn(docs.limit(0))
    assert none == [] and {r["lang_pred"] for r in language_id.predict_languages(odd, none, blank).collect()} == {"und"}


# Near duplicates


def exact_weights(sets, law="flat"):
    """Of all shingles, the frequent ones or not."""
    df = Counter(x for h, _ in sets for x in h.tolist())
    return near_dedup.Weights(np.array(list(df), np.uint64), near_dedup.inverse_frequencies(np.array(list(df.values())), len(sets), law))


def brute_classes(texts, threshold=0.8, law="flat"):
    sets = [near_dedup.shingles(t or "") for t in texts]
    idf = exact_weights(sets, law)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (len(sets[i][0]) and len(sets[j][0]) and near_dedup.weighted_jaccard(sets[i], sets[j], idf) >= threshold):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base[:12]:
        for edits in (1, 2, 3, 4, 6, 20):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    for _ in range(90):  # large buckets
        c = list(base[20])
        for _ in range(rng.choice([1, 2, 15])):
            c[rng.randrange(len(c))] = rng.choice(words)
        texts.append(" ".join(c))
    return [*texts, texts[0], texts[0], texts[30], "", None, " ", "one two", "one two", "one two three", "one  two"]


def test_near_duplicates(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("label", F.lit("clash"))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)
    kept = near_dedup.keep_one(df.withColumn("_key", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "label", "_key"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts)))


def test_near_duplicates_by_the_plain_smoothed_frequency(spark):
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicate_classes(df, law="smooth").collect()}
    want = brute_classes(texts, law="smooth")
    together = lambda c: {(i, j) for i in range(len(texts)) for j in range(i) if c[i] == c[j]}
    assert together([got[i] for i in range(len(texts))]) <= together(want)
    assert len(together([got[i] for i in range(len(texts))])) >= 0.9 * len(together(want))
    assert want != brute_classes(texts)


def test_near_duplicates_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_dedup.near_duplicate_classes(spark.createDataFrame([], schema)).count() == 0
    assert near_dedup.keep_one(spark.createDataFrame([], schema)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], schema)
    assert sorted(((r["class_id"], r["class_size"]) for r in near_dedup.near_duplicate_classes(rows).collect()), key=str) == [(4, 3), (4, 3), (4, 3), (None, 1)]
    assert sorted((r["doc_id"] for r in near_dedup.keep_one(rows).collect()), key=str) == [4, None]


def test_near_duplicates_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(120_000))
    texts = [long, long + " end", "start " + long, "x" * 2_000_000, "x" * 2_000_000 + "y", "a b c d e f g", None]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, chosen_id long")
    for name in ("chosen_key", "id", "key", "label", "rep", "body", "_row", "none", "a.b"):
        df = df.withColumn(name, F.lit(name))
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert {(r["doc_id"], r["chosen_id"], r["a.b"], r["_row"]) for r in kept.collect()} == {(k, k, "a.b", "_row") for k in (0, 3, 4, 5, 6)}


def test_shingles_are_runs_of_words():
    texts = ["a b", " a  b\tc d\ne\x0bf ", "é ü ö ß ø é ü ö ß ø é", "", "x", " ".join(str(k % 7) for k in range(90_000))]
    got = []
    for at, h, each in near_dedup.shingle_runs(pa.array([*texts, None])):
        assert at == len(got)
        got += np.split(h, np.cumsum(each)[:-1])
    names = {}
    for t, h in zip([*texts, ""], got, strict=True):
        words = t.split()
        n = min(5, len(words))
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []
        assert len(runs) == len(h)
        assert all(names.setdefault(r, x) == x for r, x in zip(runs, h.tolist(), strict=True))
    assert len(set(names.values())) == len(names)


def test_frequent_shingles_are_exact(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None]
    got = near_dedup.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text", len(texts))
    df = Counter(x for t in texts for x in near_dedup.shingles(t or "")[0].tolist())
    least = near_dedup.common_df(len(texts))
    some = sorted(h for h, n in df.items() if n > least)
    assert got.h.tolist() == some and len(some) < len(df)
    assert got.idf.tolist() == pytest.approx([float(near_dedup.inverse_frequencies(np.array([df[h]]), len(texts))[0]) for h in some])


@pytest.mark.parametrize("size", [7, 1000])
def test_blocks_lose_none(spark, monkeypatch, size):
    monkeypatch.setattr(near_dedup, "BLOCK", size)
    texts = near_texts()[:140]
    sets = [near_dedup.shingles(t) for t in texts]
    weights = exact_weights(sets)
    names = [bytes([k]) for k in range(len(texts))]
    bands = [(1, 10 + k % 2) for k in range(len(texts))]
    df = spark.createDataFrame([(bytearray(n), bytearray(n), t, list(b)) for n, t, b in zip(names, texts, bands)], "rep binary, label binary, body string, buckets array<long>")
    members = df.select(F.explode("buckets").alias("bucket"), "rep", "label", "buckets")
    links = near_dedup.block_links(members, df.select("rep", "body"), weights, 5, 0.8).collect()
    similar = lambda i, j: near_dedup.weighted_jaccard(sets[i], sets[j], weights) >= 0.8
    assert links and all(similar(r["la"][0], r["lb"][0]) for r in links)  # every text is its own class here
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in links:
        up[find(r["la"][0])] = find(r["lb"][0])
    assert all(find(i) == find(j) for i in range(len(texts)) for j in range(i) if similar(i, j))


def test_components(spark):
    rng = random.Random(5)
    n = 120
    links = [(k, k + 1) for k in range(40)] + [(50, k) for k in range(51, 90)] + [(rng.randrange(90, n), rng.randrange(90, n)) for _ in range(15)]
    up = list(range(n))
    for _ in range(n):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    key = lambda k: bytearray([k])
    labels = spark.createDataFrame([(key(k), key(k)) for k in range(n)], "rep binary, label binary")
    moves = near_dedup.joined_classes(spark.createDataFrame([(key(a), key(b)) for a, b in links if a != b], "la binary, lb binary"))
    got = near_dedup.relabel(labels, moves)
    assert got.columns == ["rep", "label"] and {r["rep"][0]: r["label"][0] for r in got.collect()} == dict(enumerate(up))


def test_sampling_is_the_similarity():
    sampler = near_dedup.Sampler(3000)
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 60, np.uint64)
    wa, wb = rng.integers(1, 5, 60).astype(float), rng.integers(1, 5, 60).astype(float)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert (sampler.sample(h, wa) == sampler.sample(h, wb)).mean() == pytest.approx(want, abs=0.04)


# Top-k


def test_top_k(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=9) * 3]) for k in range(700)]
    rows += [(1000 + k, rows[0][1]) for k in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 7), (2002, [math.nan] + [0.0] * 8), (2100, [math.inf] * 9), (None, [1.0] * 9), (2200, [1.0, 2.0]), (2203, [3.0, -1.0]), (2300, []), (2301, []), (100, rows[7][1]), (2400, [0.5] * 20)]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in good:
        if i % 100 == 0 and ((i, len(v)) not in asks or v < asks[i, len(v)]):
            asks[i, len(v)] = v
    want = {}
    for (i, n), v in asks.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == n)[:10]
        if scored:
            want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_repeated_rows_and_clashing_names(spark):
    rng = np.random.default_rng(9)
    rows = [(7, [1.0, 2.0])] * 3000 + [(k, [float(x) for x in rng.normal(size=2)]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    for name in ("c", "dim", "kind", "vec", "cutoff", "asks", "rank"):
        df = df.withColumn(name, F.lit("clash"))
    got = topk.top_k(df, F.col("vec_id") == 0).collect()
    mine = [math.floor(1024 * float(np.float32(x))) for x in rows[3000][1]]
    want = sorted((-sum(a * math.floor(1024 * float(np.float32(b))) for a, b in zip(mine, v)), i) for i, v in rows if i)[:10]
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_cutoffs_save_scores():
    rng = np.random.default_rng(10)
    c, q, k = np.floor(rng.normal(size=(4000, 16)) * 256), np.floor(rng.normal(size=(20, 16)) * 256), 10
    parts, others = topk.list_parts(q, c, 4), rng.random((20, 4000)) < 0.99
    whole = np.where(others, q @ c.T, -np.inf)
    gathered = topk.gather(parts, others, k)
    cutoffs = np.array([np.sort(topk.resolve(parts, j, at))[-k] for j, at in enumerate(gathered)])
    places = topk.sufficient(parts, others, cutoffs, topk.list_norms(q, 4), topk.list_norms(c, 4))
    for j in range(20):
        assert len(gathered[j]) <= 4 * k and set(np.argsort(-whole[j], kind="stable")[:k]) <= set(places[j])
        assert (topk.resolve(parts, j, places[j]) == whole[j, places[j]]).all()
    share = sum(map(len, places)) / others.sum()  # of the scores, so many are resolved
    assert share < 0.4, share


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e13, 1.0]), (1, [1e3, 3.0]), (2, [1e3, 2.0]), (3, [1e200, 0.0]), (4, [1e307, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=2).collect()
    # All three scores are beyond a long, so they are cut to its end and tie.
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 2**63 - 1), (2, 2, 2**63 - 1)]


# Pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in c.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "best_fit_packing"]
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", None, None, 5)], docs.schema)
    first = c.STAGES[0][1](spark, docs.unionByName(odd), sf)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.select("doc_id").collect()}
    whole = {r["doc_id"] for r in docs.where(F.length("text") > 40).select("doc_id").collect()}
    assert not kept & {10**6, 10**6 + 1} and whole <= kept
    second = c.STAGES[1][1](spark, docs, sf)
    assert second.columns == docs.columns and second.count() == docs.count()
    assert second.where(F.col("n_chars") != F.length("text")).count() == 0
    packed = c.run(spark, sf)
    spans = packed.groupBy("doc_id").agg(F.sum("length").alias("n"))
    third = c.STAGES[2][1](spark, c.STAGES[1][1](spark, c.STAGES[0][1](spark, docs, sf), sf), sf).select("doc_id", F.length("text").cast("long").alias("n"))
    assert sorted(map(tuple, spans.collect())) == sorted(map(tuple, third.collect()))


def test_pipeline_of_odd_tables(spark, tmp_path):
    """An empty table gives no rows; columns of other names pass through, and repeated rows stay once."""
    import corpus_pipeline as c

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert c.run(spark, str(tmp_path / "none")).count() == 0
    rows = [(k, f"some words of the document number {k} in English " * 3, "en", "s", 0) for k in range(20)] * 2 + [(None, "only one without an id but with words", "en", None, 0)]
    docs = spark.createDataFrame(rows, schema)
    for name in ("score", "LANG_PRED", "id", "key", "bin", "rest", "body", "HAS_LETTER", "N_LINES", "n_dropped", "_n_lines"):
        docs = docs.withColumn(name, F.lit("clash"))
    for _, stage in c.STAGES[:3]:
        before, docs = docs, stage(spark, docs, "")
        assert docs.columns == before.columns and docs.where(" OR ".join(f"{c} <> 'clash'" for c in docs.columns[5:])).count() == 0
    assert sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str) == sorted([*range(20), None], key=str)
    packed = c.STAGES[3][1](spark, docs, "")
    assert packed.groupBy("bin", "shard").agg(F.count("*").alias("n")).where("n > 2").count() == 0  # one source each, or none


def test_repeated_and_many_labels(spark):
    rows = [(k, t, g) for k in range(40) for t, g in (("the cat and the hat of the man", "en"), ("der Hund und die Katze des Mannes", "de"))] + [(k, "xyz abc", f"odd-{k}") for k in range(100, 130)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string")
    langs, net = language_id.learn(docs)
    learned = {r["lang"] for r in docs.where(~language_id.held_out()).select("lang").distinct().collect()}
    assert langs == sorted(learned) and len(langs) > 20 and 1 / len(langs) < net.floor < 1  # rare ones as well
    got = language_id.predict_languages(docs, langs, net)
    assert got.count() == len(rows) * 2 and {r["lang_pred"] for r in got.where("lang = 'en'").collect()} == {"en"}


def test_learned_documents(spark):
    rows = [(k, "de" if k % 3 else "en", f"text {k}") for k in range(300)] + [(900, None, "x"), (901, "fr", "12"), (902, "fr", "y")]
    docs = spark.createDataFrame(rows, "order long, lang string, body string")
    n = {r["lang"]: r["count"] for r in language_id.learned_documents(docs, 20).groupBy("lang").count().collect()}
    assert n == {"de": 20, "en": 20, "fr": 1}
    assert language_id.learned_documents(docs, 20, docs=6).groupBy("lang").count().where("count <> least(2, CASE lang WHEN 'fr' THEN 1 ELSE 2 END)").isEmpty()


def test_windows_cover_whole_texts():
    import pyarrow as pa

    text = "äbc " * 100
    got = pa.Table.from_batches(list(language_id._windows([pa.RecordBatch.from_arrays([pa.array(["de"]), pa.array([5]), pa.array([text])], ["lang", "doc", "body"])])))
    assert b"".join(got["raw"].to_pylist()) == text.encode() and max(len(r) for r in got["raw"].to_pylist()) == language_id.T


def test_calibration_is_on_unseen_documents():
    doc, y = np.arange(100), np.repeat([0, 1, 2, 3], 25)
    unseen = language_id.calibration_rows(doc, y)
    assert 0 < unseen.sum() < 50 and not set(doc[unseen]) & set(doc[~unseen])
    assert not language_id.calibration_rows(np.full(3, 5), np.zeros(3, int)).any()  # one document is trained on


def test_network_by_plain_loops():
    """Every document's probabilities are the mean over its bytes of a plain recurrence in both directions."""
    rng = np.random.default_rng(8)
    net = language_id.Network(3, hidden=4, seed=2)
    net.p = {k: rng.standard_normal(v.shape) * 0.5 for k, v in net.p.items()}
    logistic = lambda v: 1 / (1 + np.exp(-v))

    def states(raw, k):
        n, h, out = net.hidden, np.zeros(net.hidden), []
        for byte in raw:
            a, r = net.p["table"][k][:, byte], net.p["u"][k] @ h
            z, g = logistic(a[:n] + r[:n]), logistic(a[n : 2 * n] + r[n : 2 * n])
            c = np.tanh(a[2 * n :] + g * (r[2 * n :] + net.p["b"][k][:, 0]))
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    def plain(raw):
        every = []
        for s in range(0, len(raw), language_id.T):
            w = raw[s : s + language_id.T]
            for f, b in zip(states(w, 0), states(w[::-1], 1)[::-1], strict=True):
                y = net.p["out"][0] @ f + net.p["out"][1] @ b + net.p["bias"][:, 0]
                every.append(np.exp(y) / np.exp(y).sum())
        return np.mean(every, axis=0) if every else np.zeros(3)

    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 63, 64, 65, 200, 0, 129)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = net.documents(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got == pytest.approx(np.array([plain(t) for t in texts]), abs=1e-5)


def test_pipeline_without_labels(spark):
    """With no usable label nothing is learned; documents with letters stay."""
    import corpus_pipeline as c

    rows = [(1, "A clean document.", None), (2, "Ein Text", None), (3, "12 34 !?", None), (4, "", None), (5, None, None), (6, "\u00e9", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = c.keep_known_languages(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 6]
