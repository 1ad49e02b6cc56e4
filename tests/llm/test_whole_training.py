"""The language network learns from every labelled document, not from a sample alone."""

import numpy as np
from pyspark.sql import functions as F

from emberwatch.llm import language_id

SCHEMA = "order long, lang string, body string"


def _rows(odd=""):
    return [(k, g, f"{t} {k}" * (1 + k % 3)) for k in range(60) for g, t in (("en", "the cat and the hat"), ("de", "der Hund und die Katze"))] + [(1000, "en", f"another text {odd}")]


def _taught(spark, rows, at_most=3):
    docs = spark.createDataFrame(rows, SCHEMA)
    held = {r["doc"] for r in language_id.learned_documents(docs, at_most).collect()}
    return docs, {r["order"] for r in docs.withColumn("doc", F.xxhash64("order")).collect() if r["doc"] not in held and r["doc"] % language_id.CALIBRATE}


def test_a_document_outside_the_sample_counts(spark):
    docs, beyond = _taught(spark, _rows())
    at = min(beyond)
    other = docs.withColumn("body", F.when(F.col("order") == at, F.lit("zzz qqq")).otherwise(F.col("body")))
    a, b = (language_id.train_languages(d, 3)[1] for d in (docs, other))
    assert any((a.p[k] != b.p[k]).any() for k in a.p)


def test_the_network_does_not_follow_the_splits(spark):
    docs, _ = _taught(spark, _rows())
    a, b = (language_id.train_languages(docs.repartition(n), 3)[1] for n in (1, 5))
    assert all((a.p[k] == b.p[k]).all() for k in a.p) and a.floor == b.floor


def test_pieces_hold_all_windows_and_divide_a_documents_weight():
    import pyarrow as pa

    texts = ["ä" * 100, "", "x", "y" * 64]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 0, 1], pa.int32()), pa.array([2.0, 1.0, 1.0, 3.0]), pa.array(texts)], ["y", "weight", "body"])
    x, n, y, w = (np.concatenate(c) for c in zip(*language_id._pieces([batch.slice(0, 2), batch.slice(2)], 3), strict=True))
    assert b"".join(bytes(r[:k]) for r, k in zip(x, n, strict=True)).decode() == "".join(texts)
    assert y.tolist() == [1, 1, 1, 1, 0, 1] and w.tolist() == [0.5] * 4 + [1.0, 3.0]


def test_floor():
    assert language_id.floor_of(4, {}) == 0.25
    assert language_id.floor_of(4, {5000: 1, 9000: 999}) == (0.25 + 0.5) / 2
    assert language_id.floor_of(4, {5000: 1, 9000: 4999}) == (0.25 + 0.9) / 2
