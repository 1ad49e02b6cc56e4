"""License scans: an exact set-similarity join of text blocks with license templates.

Words of a text are ASCII letters (in lower case), digits and all that isn't ASCII. A template is a set of words; a block
contains it if the block has at least THRESHOLD percent of these. Blocks are windows over the words of a text, made for each
size class of templates: a template of at most `s` words, s a power of two, meets windows of 2 s words that begin every s
words, so that each run of s words stands whole in one of them.

The join is exact. Words of templates are ordered by their number of documents, rarest first. Of two sets that have
`need` words in common, the first |A| - need + 1 words of one and the first |B| - need + 1 of the other meet (prefix
filter); a set of fewer than `need` words can't qualify (length filter); and from their first common word on, both must
have `need` words left (positional filter). Words outside all templates of a class can't be common and don't count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.common import BROADCAST_ROWS, cut, table

# Phrases that name a license, and the wording of public license notices. Members of a family that differ in a
# word or two (versions, lesser, non-commercial) are within the threshold of each other, so a family has one template.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"),
    ("gpl", "licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
]
THRESHOLD = 80
#: Bytes of texts that are worked on at once; a longer text is read by pieces of this size.
CHUNK, LEAST_CLASS = 1 << 20, 8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def need(size: int, threshold: int = THRESHOLD) -> int:
    """Words of a template of `size` distinct words that a block must have."""
    return max(1, -(-size * threshold // 100))


def size_class(template: str) -> int:
    """The least power of two that the words of a template don't pass."""
    return max(LEAST_CLASS, 1 << (max(1, len(words(template))) - 1).bit_length())


class Vocabulary:
    """Codes of the words that phrases and templates are made of."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], threshold: int) -> None:
        self.phrases = [(words(p), label) for p, label in phrases.items() if words(p)]
        self.templates = [(label, size_class(t), sorted(set(words(t)))) for label, t in templates if words(t)]
        known = sorted({w for p, _ in self.phrases for w in p} | {w for _, _, t in self.templates for w in t})
        self.words, self.code = known, {w: k for k, w in enumerate(known)}
        self.runs = [(np.array([self.code[w] for w in p]), label) for p, label in self.phrases]
        #: Of each class: whether a word is of one of its templates, and the least number of common words that counts.
        self.classes = {}
        for s in sorted({s for _, s, _ in self.templates}):
            own = [t for _, c, t in self.templates if c == s]
            member = np.zeros(len(known), bool)
            member[[self.code[w] for t in own for w in t]] = True
            self.classes[s] = (member, min(need(len(t), threshold) for t in own))

    def codes(self, text: bytes) -> np.ndarray:
        """Codes of the words of a text in lower case; -1 for words outside."""
        get, parts, at = self.code.get, [], 0
        while at < len(text):
            end = at + CHUNK
            if end < len(text):  # not within a word
                gap = re.compile(rb"[^0-9a-z\x80-\xff]").search(text, end)
                end = gap.start() if gap else len(text)
            found = WORD.findall(text[at:end])
            parts.append(np.fromiter((get(w, -1) for w in found), np.int32, len(found)))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _texts(column: pa.Array):
    """Lists of a column's texts as bytes in lower case, with CHUNK bytes or one longer text each."""
    held, size = [], 0
    for x in column:
        raw = (x.as_py() or "").encode("utf-8", "surrogatepass").lower()
        if held and size + len(raw) > CHUNK:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def document_frequencies(bodies: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Number of documents that have each word of the vocabulary. A task adds up before it sends on; what the driver gets
    is bounded by the templates."""

    def run(batches):
        total = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for texts in _texts(batch.column(0)):
                for t in texts:
                    c = vocabulary.codes(t)
                    total[np.unique(c[c >= 0])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    got = bodies.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary.words), np.int64)
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out


def find_blocks(doc: np.ndarray, at: np.ndarray, ranks: np.ndarray, size: int, least: int):
    """(document, window, sorted distinct ranks) of the windows of 2 `size` words that have `least` different ones or more.
    `doc`, `at`, `ranks`: document, place and rank of each word that counts, in order."""
    if not len(ranks):
        return
    w = at // size
    both = np.concatenate([np.stack([doc, w, ranks]), np.stack([doc, w - 1, ranks])[:, w > 0]], axis=1)
    both = np.unique(both, axis=1)
    new = np.ones(both.shape[1], bool)
    new[1:] = (both[:2, 1:] != both[:2, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    ends = np.append(first[1:], both.shape[1])
    for a, b in zip(first[ends - first >= least].tolist(), ends[ends - first >= least].tolist(), strict=True):
        yield int(both[0, a]), int(both[1, a]), both[2, a:b]


def _scan(vocabulary: Vocabulary, rank: np.ndarray):
    """(id, n_words, n_base, first_word, last_word, base, blocks) of (id, body)."""
    block = pa.struct([("class", pa.int32()), ("window", pa.int64()), ("ranks", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            at = 0
            for texts in _texts(batch.column(1)):
                own = [vocabulary.codes(t) for t in texts]
                sizes = np.array([len(c) for c in own])
                starts = np.cumsum(sizes + 1) - sizes - 1
                flat = np.concatenate([x for c in own for x in (c, [-1])]).astype(np.int32)  # no phrase crosses texts
                counts, first, last = np.zeros(len(own), np.int64), np.full(len(own), 1 << 62), np.full(len(own), -1)
                base: list[set] = [set() for _ in own]
                for codes, label in vocabulary.runs:
                    hit = np.flatnonzero(flat[: len(flat) - len(codes) + 1] == codes[0])
                    for k in range(1, len(codes)):
                        hit = hit[flat[hit + k] == codes[k]]
                    d = np.searchsorted(starts, hit, "right") - 1
                    np.add.at(counts, d, 1)
                    np.minimum.at(first, d, hit - starts[d])
                    np.maximum.at(last, d, hit - starts[d])
                    for x in np.unique(d).tolist():
                        base[x].add(label)
                blocks: list[list] = [[] for _ in own]
                live = np.flatnonzero(flat >= 0)
                for size, (member, least) in vocabulary.classes.items():
                    some = live[member[flat[live]]]
                    d = np.searchsorted(starts, some, "right") - 1
                    for x, window, ranks in find_blocks(d, some - starts[d], rank[flat[some]], size, least):
                        blocks[x].append({"class": size, "window": window, "ranks": ranks})
                none = counts == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(own)), pa.array(sizes), pa.array(counts), pa.array(first, mask=none), pa.array(last, mask=none),
                        pa.array([sorted(b) for b in base], pa.list_(pa.string())), pa.array(blocks, pa.list_(block)),
                    ],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )
                at += len(own)

    return run


def template_index(spark: SparkSession, vocabulary: Vocabulary, rank: np.ndarray, threshold: int) -> DataFrame:
    """(class, rank, place, template, label, size, need, words): the prefix words of each template, by global rank."""
    rows = []
    for k, (label, size, own) in enumerate(vocabulary.templates):
        ordered = sorted(int(rank[vocabulary.code[w]]) for w in own)
        least = need(len(ordered), threshold)
        rows += [(size, r, i, k, label, len(ordered), least, ordered) for i, r in enumerate(ordered[: len(ordered) - least + 1])]
    index = spark.createDataFrame(rows, "class int, rank int, place int, template int, label string, size int, need int, words array<int>")
    return F.broadcast(index) if len(rows) <= BROADCAST_ROWS else index


def matching_blocks(blocks: DataFrame, index: DataFrame) -> DataFrame:
    """(row, class, window, template, label, common, size) of every block (row, class, window, ranks) that has the words
    that a template needs."""
    shortest = index.groupBy("class").agg(F.min("need").alias("least"))
    cand = blocks.join(shortest, "class").where(F.size("ranks") >= F.col("least"))
    cand = cand.select("row", "class", "window", "ranks", F.posexplode(F.slice("ranks", F.lit(1), F.size("ranks") - F.col("least") + 1)).alias("pos", "rank"))
    met = cand.join(index, ["class", "rank"])
    left = F.least(F.size("ranks") - F.col("pos"), F.col("size") - F.col("place"))
    met = met.where((F.size("ranks") >= F.col("need")) & (F.col("pos") <= F.size("ranks") - F.col("need")) & (left >= F.col("need")))
    met = met.groupBy("row", "class", "window", "template").agg(*[F.first(c).alias(c) for c in ("ranks", "label", "size", "need", "words")])
    met = met.withColumn("common", F.size(F.array_intersect("ranks", "words")))
    return met.where(F.col("common") >= F.col("need")).select("row", "class", "window", "template", "label", "common", "size")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """One row a document: `id_col`, n_words, n_base (places of phrases), first_word and last_word (their smallest and
    largest start; null without one), base_labels and labels (sorted arrays), score and `matches`.

    `matches` has a struct for each block and template whose containment reaches `threshold` percent: template (its
    number), label, start and end word of the block, and containment. `labels` are those of phrases and matches; `score`
    is 1 where a phrase stands, else the greatest containment among the matches, else 0.

    Null or empty text: no words, no labels, score 0. Null ids and repeated rows are kept, a result for each row. No rows:
    no rows. No templates or phrases: none are found. Other columns are not read, and their names don't matter.

    Texts are read twice (frequencies, blocks) and never shuffled; of most texts no block passes the length filter. Blocks
    and counts are checkpointed by row, so a text with very many blocks is dealt by block, and no other row waits for it.
    """
    spark = docs.sparkSession
    vocabulary = Vocabulary(phrases, templates, threshold)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body"))
    df = document_frequencies(src.select("body"), vocabulary)
    rank = np.empty(len(df), np.int32)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))  # ties by word
    kind = src.schema["id"].dataType.simpleString()
    block = "array<struct<class: int, window: long, ranks: array<int>>>"
    scanned = src.mapInArrow(_scan(vocabulary, rank), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, blocks {block}")
    scanned = cut(scanned.withColumn("row", F.monotonically_increasing_id()))
    blocks = scanned.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    found = matching_blocks(blocks, template_index(spark, vocabulary, rank, threshold))
    match = F.struct(
        "template", "label", (F.col("window") * F.col("class")).alias("start"), ((F.col("window") + 2) * F.col("class")).alias("end"), (F.col("common") / F.col("size")).alias("containment")
    )
    per_row = cut(found.groupBy("row").agg(F.sort_array(F.collect_list(match)).alias("matches")))
    rows = scanned.drop("blocks").join(per_row.hint("merge"), "row", "left")
    matches = F.coalesce("matches", F.array().cast("array<struct<template: int, label: string, start: long, end: long, containment: double>>"))
    rows = rows.withColumn("matches", matches)
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.col("base").alias("base_labels"),
        F.sort_array(F.array_union("base", F.transform("matches", lambda m: m["label"]))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "matches",
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return out.withColumns(joined).drop("matches")


def brute_force_sql(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> str:
    """Every window against every template, without a filter."""
    quoted = lambda ws: "[" + ", ".join("'" + w.decode().replace("'", "''") + "'" for w in ws) + "]"
    base = ", ".join(f"({quoted(words(p))}, '{label}')" for p, label in phrases.items())
    rows = ", ".join(f"({size_class(t)}, '{label}', {quoted(sorted(set(words(t))))}, {need(len(set(words(t))), threshold)})" for label, t in templates)
    return rf"""
WITH phrases(p, label) AS (VALUES {base}), templates(size, label, t, need) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
w AS (SELECT row, doc_id, regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
places AS (SELECT row, label, i - 1 AS pos FROM w, phrases, unnest(range(1, len(w) - len(p) + 2)) AS u(i) WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
based AS (SELECT row, count(*) AS n, min(pos) AS first, max(pos) AS last, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM places GROUP BY row),
windows AS (SELECT row, size, list_distinct(w[k * size + 1:(k + 2) * size]) AS b
            FROM w, (SELECT DISTINCT size FROM templates), unnest(range(0, greatest(1, (len(w) + size - 1) // size))) AS u(k)),
hits AS (SELECT row, label, len(list_intersect(b, t)) / len(t) AS share FROM windows JOIN templates USING (size) WHERE len(b) >= need AND len(list_intersect(b, t)) >= need),
found AS (SELECT row, max(share) AS best FROM hits GROUP BY row),
labelled AS (SELECT row, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT row, label FROM hits UNION ALL SELECT row, label FROM places) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word, coalesce(based.labels, '') AS base_labels,
       coalesce(labelled.labels, '') AS labels, CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN based USING (row) LEFT JOIN found USING (row) LEFT JOIN labelled USING (row)
"""


SQL = brute_force_sql()
