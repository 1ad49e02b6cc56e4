"""Line dedup, fingerprints, BPE, unigram counts and packing against brute force, with their edge cases."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import bpe, fingerprint, line_dedup, packing, unigram

public = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " ", "\n", "\n\n", "a", "é🙂\u2028x", "x" * 70_000, "\t tab \x0b\x0c", "▁ ▁▁", "don't  stop\r\n", "日本語 text 123 ½", "\x1c\x85\xa0 a"]


def frame(spark, texts, ids=None, **cols):
    rows = [(i, t, "en", f"s{k % 3}", 0) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, DOC)


# Line dedup


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))


def brute_lines(docs):
    holders = defaultdict(set)
    for n, (i, t) in enumerate(docs):
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= 20:
                holders[line_key(x)].add((n if i is None else -1, i))  # rows of an id are one document
    keep = {k: max((i for _, i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        left = [x for x in lines if line_key(x) not in keep or keep[line_key(x)] is None or keep[line_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = [f"A Line that is common number {k}" for k in range(12)] + ["short", "", "  É ÀB a line of the other kind \t", "a common LINE, NUMBER 3 twenty", "A COMMON line, number 3 twenty  "]
    docs = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for k in range(60)]
    docs += [(None, pool[0]), (None, "one only, but long enough to count")] + [(100 + k, t) for k, t in enumerate(ODD)]
    docs += [(7, docs[7][1]), (59, pool[0]), (59, pool[0])]
    got = line_dedup.dedup_lines(frame(spark, [t for _, t in docs], [i for i, _ in docs]))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=str) == brute_lines(docs)


def test_line_dedup_odd_tables(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    clash = frame(spark, ["a\nb"]).select("doc_id", "text", F.lit(9).alias("N_LINES"), F.lit("r").alias("rk"), F.lit("b").alias("body"), F.lit(7).alias("n_dropped"))
    assert line_dedup.dedup_lines(clash).collect()[0].asDict() == {"doc_id": 0, "text": "a\nb", "N_LINES": 9, "rk": "r", "body": "b", "n_dropped": 7, "_n_lines": 2, "_n_dropped": 0}


def test_long_documents_cost_in_proportion(spark):
    lines = [f"the line of number {k} of this document" for k in range(100_000)]
    docs = frame(spark, ["\n".join(lines)] * 3)
    start = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["size"]) for r in line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.length("text").alias("size")).collect()}
    assert got == {0: (100_000, 100_000, 0), 1: (100_000, 100_000, 0), 2: (100_000, 0, len("\n".join(lines)))}
    assert time.time() - start < 90  # a text that is split for each of its lines takes hours


# Fingerprints


def test_edits(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gämma", "🙂delta", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ODD
    ids = rng.sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_edits(frame(spark, texts, ids)).collect()}
    order = sorted(zip(ids, texts))
    assert len(got) == len(order)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["near_edited"] == fingerprint.likeness(r["fingerprint"], r["edited_fingerprint"])
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (t == edited)
        same = next((k for k, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))
        assert r["common_prefix"] == same


def test_edits_of_ties_and_nulls(spark):
    got = fingerprint.fingerprint_edits(frame(spark, ["b", "a", "a", "zz"], [1, 1, None, None])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == [(False, 1, 1), (False, 1, 1), (True, 0, 1), (True, 0, 2)]
    assert fingerprint.fingerprint_edits(frame(spark, [])).count() == 0
    alone = fingerprint.fingerprint_edits(frame(spark, ["abcd"])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and alone["near_next"] == 1.0


def test_edits_of_hot_ids_and_rows(spark):
    rng = random.Random(12)
    rows = [(rng.choice([None, None, 5, k, 2**60 + k % 3]), rng.choice(["", "same text", "same text", f"text {k}", f"another one {k % 20}"])) for k in range(600)]
    rows += [(2**60 + 1, "big")] * 300 + [(None, "same text")] * 900
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(5)
    got = fingerprint.fingerprint_edits(df.withColumn("times", F.lit(1)).withColumn("bucket", F.lit("clash")))
    assert got.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 2
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]], r[1]))
    want = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[(i, hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest(), t == n)] += 1
    assert Counter((r["doc_id"], r["edited_sha256"], r["near_next"] == 1) for r in got.collect()) == want


def test_likeness_follows_the_text():
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefghij "), 4000))
    fp = lambda t: (lambda p: fingerprint.encode(p, fingerprint.sketch(p)))(fingerprint.Prefix(fingerprint.code_points(t)))
    other = "".join(rng.choice(list("abcdefghij "), 4000))
    half = fingerprint.likeness(fp(text), fp(text[:2000] + other[:2000]))
    assert 0.35 < half < 0.65 and fingerprint.likeness(fp(text), fp(other)) < 0.1 and fingerprint.likeness(fp(text), fp(text)) == 1


def test_spans():
    rng = random.Random(4)
    a, b = ("".join(rng.choice("ab") for _ in range(300)) for _ in range(2))
    pa, pb = fingerprint.Prefix(fingerprint.code_points(a)), fingerprint.Prefix(fingerprint.code_points(b))
    for _ in range(300):
        i, j, n = rng.randrange(300), rng.randrange(300), rng.randrange(6)
        assert fingerprint.spans_equal(pa, i, pb, j, n) == (i + n <= 300 and j + n <= 300 and a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < 300 and j + k < 300 and a[i + k] == b[j + k]:
            k += 1
        assert fingerprint.common_extension(pa, i, pb, j) == k


def test_span_table(spark):
    df = spark.createDataFrame([("abc", "xabc", 0, 1, 3), (None, "a", 0, 0, 1)], "a string, b string, i int, j int, n int")
    assert [(r["equal"], r["extension"]) for r in fingerprint.common_spans(df, "a", "b", "i", "j", "n").collect()] == [(True, 3), (False, 0)]
    fps = [r["fingerprint"] for r in fingerprint.fingerprint_documents(frame(spark, ["x y", "x y", None, ""], [1, None, 2, 3])).collect()]
    assert fps[0] == fps[1] and fps[2] == fps[3] and fps[0] != fps[2]


# BPE


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe(spark, sf, tik):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    got = bpe.encode_documents(frame(spark, texts), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == tik.encode_ordinary(t) and bytes(r["decoded"]) == t.encode() and r["n_tokens"] == len(r["ids"])
    assert bpe.encode_documents(frame(spark, []), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).count() == 0


def test_prefix_encoder(tik):
    v = bpe.Vocabulary(public.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(6)
    raw = lambda n: "".join(rng.choice("thenaio ré") for _ in range(n)).encode()
    for _ in range(40):
        a, b, c = raw(30), raw(10), raw(8)
        e = bpe.PrefixEncoder(v, a)
        assert e.ids() == v.merged(a)
        assert e.append(b).ids() == v.merged(a + b)
        at = rng.randrange(len(a))
        assert e.replace(at, at + 3, c).ids() == v.merged((a + b)[:at] + c + (a + b)[at + 3 :])
        assert v.last(a) == e.v.merged(a)[-1]


# Unigram counts


def test_unigram(spark, sf):
    from tokenizers import Tokenizer, models

    pieces, bytes_too = unigram.load_pieces(public.path("piece_bpe_32k.model"))
    assert bytes_too
    vocab = [("<unk>", 0.0), *[(f"<0x{k:02X}>", 0.0) for k in range(256)], *pieces]
    theirs = Tokenizer(models.Unigram(vocab, 0, True))
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD
    got = {r["doc_id"]: r["n_tokens"] for r in unigram.count_tokens(frame(spark, texts), public.path("piece_bpe_32k.model")).collect()}
    for k, t in enumerate(texts):
        marked = "▁" + t.replace(" ", "▁") if t else ""
        assert got[k] == len(theirs.encode(marked, add_special_tokens=False).ids), t


def test_odd_rows_of_token_operators(spark):
    """Null ids, repeated rows, clashing names and empty tables, for both token operators."""
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_tokens", "ids", "decoded", "id", "body"):
        df = df.withColumn(name, F.lit("clash"))
    piece, ranks = public.path("piece_bpe_32k.model"), public.path("byte_bpe_50k.tiktoken")
    counted = unigram.count_tokens(df, piece).collect()
    coded = bpe.encode_documents(df, ranks, public.PATTERN).collect()
    for got in (counted, coded):
        assert sorted((r["doc_id"] for r in got), key=str) == [1, 1, 2, None]
        n = {r["doc_id"]: r["n_tokens"] for r in got}
        assert n[2] == 0 and n[None] == n[1] > 0
    assert unigram.count_tokens(df.limit(0), piece).count() == 0


def test_unigram_ties_and_brute_force():
    rng = random.Random(7)
    pieces = [("▁", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -3.0), ("ba", -3.0), ("aab", -5.0), ("▁▁", -1.0)]
    u = unigram.Unigram(pieces)
    scores = dict(pieces)

    def best(text):
        table = [(0, 0.0)] + [None] * len(text)
        for start in range(len(text)):
            for end in range(start + 1, len(text) + 1):
                p = text[start:end]
                if p in scores:
                    add, n = scores[p], 1
                elif len(p) == 1:
                    add, n = min(scores.values()) - 10, len(p.encode())
                else:
                    continue
                count, score = table[start]
                if table[end] is None or score + add > table[end][1]:
                    table[end] = (count + n, score + add)
        return table[-1]

    for _ in range(300):
        text = "".join(rng.choice("ab cé") for _ in range(rng.randint(1, 12)))
        assert u.count(text) == pytest.approx(best("▁" + text.replace(" ", "▁")))


# Packing


def check_bins(rows, docs, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["shard"], r["bin"]].append(r)
    for held in bins.values():
        assert sum(r["length"] for r in held) <= capacity and {r["bin_filled"] for r in held} == {sum(r["length"] for r in held)}
        sources = [docs[r["id"]][1] for r in held if docs[r["id"]][1] is not None]
        texts = [docs[r["id"]][0] or "" for r in held]
        assert len(set(sources)) == len(sources) and len(set(texts)) == len(texts)
    spans = defaultdict(list)
    for r in rows:
        spans[r["id"]].append((r["start"], r["length"]))
    for i, (t, _) in docs.items():
        at = 0
        for start, length in sorted(spans[i]):
            assert start == at
            at += length
        assert at == len(t or "")


def brute_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(cap, b) for b, (cap, ss, cc) in enumerate(bins) if cap >= size and cap > 0 and (s < 0 or s not in ss) and (c < 0 or c not in cc)]
        if fits:
            b = min(fits)[1]
        else:
            bins.append([capacity, set(), set()])
            b = len(bins) - 1
        bins[b][0] -= size
        bins[b][1].add(s)
        bins[b][2].add(c)
        out.append(b)
    return out


def test_best_fit_is_brute_force():
    rng = np.random.default_rng(8)
    for n, kinds in ((400, 5), (400, 90), (50, 1)):
        sizes = np.sort(rng.integers(0, 60, n))[::-1]
        sources, clusters = rng.integers(-1, kinds, n), rng.integers(-1, n // 2, n)
        assert packing.pack_shard(sizes, sources, clusters, 100).tolist() == brute_fit(sizes, sources, clusters, 100)


def test_packing(spark):
    rng = random.Random(9)
    texts = ["x" * rng.randint(0, 250) + str(k % 40) for k in range(300)] + ODD
    docs = {k: (t, rng.choice(["hot", "hot", "a", "b", None])) for k, t in enumerate(texts)}
    df = spark.createDataFrame([(k, t, s) for k, (t, s) in docs.items()], "doc_id long, text string, source string")
    check_bins(packing.pack_best_fit(df, capacity=100, shard_rows=64).collect(), docs, 100)
    assert packing.pack_best_fit(df.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a", None)] * 3, "doc_id long, text string, source string")
    assert len({(r["shard"], r["bin"]) for r in packing.pack_best_fit(same).collect()}) == 3


def test_packing_of_many_equal_rows(spark):
    same = spark.range(0, 20_000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a text").alias("text"), F.lit("s").alias("source"))
    for name in ("shard", "part", "nth", "n", "cluster", "id"):
        same = same.withColumn(name, F.lit("clash"))
    got = packing.pack_best_fit(same, shard_rows=500)
    assert got.select("shard", "bin").distinct().count() == 20_000
    assert got.groupBy("shard").count().agg(F.max("count")).first()[0] < 1000
