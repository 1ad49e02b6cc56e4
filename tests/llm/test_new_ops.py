"""Filter audit, fill-in-the-middle and license scans against brute force, with their edge cases."""

import hashlib
import random
import re
import time
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from emberwatch.llm import fill_middle, filter_audit, license_scan

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"
ODD = ["", None, " ", "\n", "a", "é🙂 x", "x" * 70_000, "\t tab \x0b\x0c", "日本語 text 123 ½", "\x1c\x85\xa0 a", "abc def", "ab\x00cd", "🙂" * 9, "zzzzzzz🙂", "aaaaaaaa" * 3, "é"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOC)


# Filter audit


def fails(rows):
    out = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        earlier = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append((s or "", i, [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), earlier]))
    return out


def brute_audit(rows, labels):
    judged = fails(rows)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = {}
    for part in {p for p, _, _ in judged}:
        docs = [(i, f) for p, i, f in judged if p == part]
        total = [0] * 5
        for order in permutations(range(5)):
            left = docs
            for step, k in enumerate(order, 1):
                gone = [d for d in left if d[1][k]]
                before = len([d for d in docs if d[1][k]]) - len(gone)
                left = [d for d in left if not d[1][k]]
                total[k] += len(gone)
                alone = sum(f[k] and sum(f) == 1 for _, f in docs)
                out[part, "".join("ABCDE"[x] for x in order), step] = [len(left), len(gone), before, alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total["ABCDE".index(order[step - 1])])
    return out


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in df.collect()}


def corpus(rng):
    words = ["plain", "Some", "WORDS", "of", "text"] + [f"w{k}" for k in range(300)]
    rows = []
    for k in range(120):
        text = " ".join(rng.choice(words[: rng.choice([5, 60, 305])]) for _ in range(rng.choice([3, 150, 230, 400]))) + rng.choice(["", "", " #", " a|b"])
        rows.append((k, text, rng.choice(["s0", "s1", None, ""])))
    rows += [(200 + k, rng.choice(rows)[1], "s1") for k in range(30)] + [(300 + k, t, "odd") for k, t in enumerate(ODD)]
    return rows + [(None, rows[3][1], "s0"), (None, None, None), rows[5], (rows[6][0], rows[6][1], "s9"), (rows[7][0], "another text", "s0")]


def test_filter_audit(spark):
    rng = random.Random(3)
    rows = corpus(rng)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 260, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    got = audited(filter_audit.filter_interactions(documents(spark, rows), spark.createDataFrame(labels, LABEL)))
    assert got == brute_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})


def test_filter_audit_odd_tables(spark):
    none = spark.createDataFrame([], LABEL)
    assert filter_audit.filter_interactions(documents(spark, []), none).count() == 0
    rows = [(1, "a", "x"), (2, "a", "x")]
    clash = documents(spark, rows).withColumns({c: F.lit("v") for c in ("part", "key", "mask", "n", "id", "good", "first", "text_", "docs")})
    labels = none.withColumns({c: F.lit("v") for c in ("doc", "good", "id")})
    assert audited(filter_audit.filter_interactions(clash, labels)) == brute_audit(rows, [])


def test_audit_is_a_contraction():
    """Each selector of an axis is pass, fail or all: sums over masks say the same."""
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, (3, 3, 2, 2, 2, 2, 2))
    got = filter_audit.audit_tensors(counts)
    for o, order in enumerate(permutations(range(5))):
        for step, f in enumerate(order):
            at = [slice(None)] * 5
            for b in order[:step]:
                at[b] = 0
            at[f] = 1
            assert (got["removed"][:, o, step] == counts[(slice(None), 0, *at)].reshape(3, -1).sum(axis=1)).all()
            at[f] = 0
            assert (got["kept"][:, o, step] == counts[(slice(None), 0, *at)].reshape(3, -1).sum(axis=1)).all()


def test_filter_audit_hot_text_and_part(spark):
    rows = [(k, "same text" if k % 3 else f"other {k}", "hot") for k in range(3000)]
    got = audited(filter_audit.filter_interactions(documents(spark, rows), spark.createDataFrame([], LABEL)))
    assert got["hot", "EABCD", 1][:2] == [1001, 1999]


# Fill in the middle


def brute_fim(i, text, seed=1):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    prefix, middle, suffix = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    if h4 % 100 < 20:
        return len(u), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(u), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts(rng):
    pool = ["a", "Z", "word", "é", "🙂", " ", "\n", "<", ">", "P", "<P", "S>", "{", "[", "@", "`", "\x7f", "ࠀ", "日"]
    return ODD + ["<P>", "x<S>y", "a <M", "<S<P<M", "<<P", "y" * 9_000_000] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)]


def test_fill_in_middle(spark):
    rng = random.Random(4)
    rows = [(k, t, "s") for k, t in enumerate(odd_texts(rng))] + [(None, "a null id", "s"), (3, "again", "s"), (3, "again", "s")]
    done = fill_middle.fill_in_middle(documents(spark, rows))
    got = done.withColumn("restored", fill_middle.restore(F.col("form"), F.col("output"))).collect()
    assert len(got) == len(rows)
    want = {(i, t): brute_fim(i, t) for i, t, _ in rows}
    assert {(r["doc_id"], r["text"]): (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got} == want
    assert all(r["restored"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_marks_units():
    """Ends by arithmetic are the ends that the pattern gives, wherever a text begins in its word of eight bytes."""
    rng = random.Random(5)
    texts = [t or "" for t in odd_texts(rng) if not t or len(t) < 1000]
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(x) for x in raw])
    units = fill_middle.Units(np.frombuffer(b"".join(raw), np.uint8), ends)
    places = [e - len(x) + len("".join(u[: k + 1]).encode()) for t, x, e in zip(texts, raw, ends.tolist(), strict=True) for u in [re.findall("[A-Za-z]+|[^A-Za-z]", t)] for k in range(len(u))]
    assert units.select(np.arange(1, len(places) + 1)).tolist() == places
    assert units.rank(np.array(places)).tolist() == list(range(1, len(places) + 1))
    assert units.select(np.array([0])).tolist() == [0]


def test_fill_in_middle_odd_tables(spark):
    assert fill_middle.fill_in_middle(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "some text here", "s")]).withColumns({"N": F.lit("mine"), "Output": F.lit(5), "_output": F.lit(6)})
    out = fill_middle.fill_in_middle(clash)
    assert out.columns == [*clash.columns, "_n", "form", "prefix_chars", "middle_chars", "__output"]
    row = out.collect()[0].asDict()
    assert (row["N"], row["Output"], row["_output"]) == ("mine", 5, 6)
    assert (row["_n"], row["form"], row["prefix_chars"], row["middle_chars"], row["__output"]) == brute_fim(1, "some text here")


# License scans

PHRASES = license_scan.PHRASES


def brute_licenses(text, templates, threshold=80, phrases=PHRASES):
    lowered = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    matches = []
    for n, (label, t) in enumerate(templates):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
        size = 8
        while size < len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)):
            size *= 2
        for k in range(max(1, -(-len(w) // size))):
            common = len(own & set(w[k * size : (k + 2) * size]))
            if 100 * common >= threshold * len(own) > 0:
                matches.append((n, label, k * size, (k + 2) * size, common / len(own)))
    labels = {x for _, x in places}
    score = 1.0 if places else max((m[4] for m in matches), default=0.0)
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted(labels), sorted(labels | {m[1] for m in matches}), score, sorted(matches)


def scanned(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"], [tuple(m) for m in r["matches"]]) for r in df.collect())


def license_texts(rng):
    notices = [t for _, t in license_scan.TEMPLATES] + list(PHRASES) + ["Released under the MIT License.", "CC BY-NC 4.0", "the Apache License, Version 2.0"]
    common = sorted({w for t in notices for w in t.split()})
    texts = list(ODD) + ["CC BY", "nc", "cc by nc cc by nc", "cc-by_nc", "under the mit", "license", "ünder the MIT License", "under the mit licenseé"]
    for _ in range(150):
        w = [rng.choice(common + ["filler"] * len(common)) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(notices).split()
            t = [x if rng.random() > 0.12 else "other" for x in t]
            at = rng.randint(0, len(w))
            w[at:at] = t
        texts.append(" ".join(w))
    return texts


def test_license_scan(spark):
    rng = random.Random(6)
    rows = [(k, t, "s") for k, t in enumerate(license_texts(rng))] + [(None, "under the MIT license", "s"), (2, "cc by nc", "s"), (2, "cc by nc", "s")]
    got = scanned(license_scan.license_scan(documents(spark, rows)))
    assert got == sorted((str(i), *brute_licenses(t, license_scan.TEMPLATES)) for i, t, _ in rows)
    assert {"mit", "isc", "bsd", "gpl", "mpl-2", "cc-by"} <= {x for r in got for x in r[6]}


def test_license_scan_any_templates(spark):
    """Few words, many templates, every threshold: the filters lose no block."""
    rng = random.Random(7)
    vocab = [f"w{k}" for k in range(25)]
    templates = [(f"t{k}", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 20)))) for k in range(12)] + [("none", "-- !")]
    rows = [(k, " ".join(rng.choice(vocab + ["x"] * 9) for _ in range(rng.randint(0, 90))), "s") for k in range(60)]
    for threshold in (1, 50, 80, 100):
        got = scanned(license_scan.license_scan(documents(spark, rows), templates=templates, threshold=threshold))
        assert got == sorted((str(i), *brute_licenses(t, templates, threshold)) for i, t, _ in rows)


def test_license_scan_odd_tables(spark):
    assert license_scan.license_scan(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "under the mit license", "s")]).withColumns({c: F.lit("v") for c in ("row", "id", "body", "labels", "blocks", "N_words")})
    assert scanned(license_scan.license_scan(clash)) == [("1", *brute_licenses("under the mit license", license_scan.TEMPLATES))]
    nothing = license_scan.license_scan(documents(spark, [(1, "under the mit license", "s")]), phrases={}, templates=[])
    assert scanned(nothing) == [("1", 4, 0, None, None, [], [], 0.0, [])]


def test_license_scan_is_linear(spark):
    def took(n):
        began = time.time()
        license_scan.license_scan(documents(spark, [(1, "This work is licensed under the GNU General Public License, version 3. " * n, "s")])).collect()
        return time.time() - began

    took(10)
    assert took(40_000) < 60


def test_license_text_by_pieces(monkeypatch):
    monkeypatch.setattr(license_scan, "CHUNK", 7)
    v = license_scan.Vocabulary(PHRASES, license_scan.TEMPLATES, 80)
    text = "released under the mit license, ünder the apache license version 2 " * 5
    assert v.codes(text.encode()).tolist() == [v.code.get(w, -1) for w in license_scan.words(text)]
