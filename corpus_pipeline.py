"""A training-data pipeline over `documents`: language, repeated lines, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; each result is written as
Parquet and read again as the next one's input.

Nulls and odd rows: a document of null or empty text, or without a letter, has no language and goes in the first stage.
Null ids are never the largest holder of a line and come last among copies; null sources don't conflict. Repeated rows
are copies, of which one stays. Ties go to the smaller id. Very long texts are read whole. An empty table gives no rows.
Columns beyond those of `documents` pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm import language_id, line_dedup, near_dedup, packing
from emberwatch.llm.common import shared_path, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is undetermined (no text, no letter) or improbable: below the score that
    the network's own calibration finds. Where no language could be learned, for want of labels, all that have a letter
    stay."""
    langs, net = language_id.learn(docs)
    if not langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = language_id.predict_languages(docs, langs, net)
    lang, score = judged.columns[-2:]
    return judged.where((F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= net.floor)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With lines of three documents or more kept in one only; `n_chars` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With one document of each group of near copies, that of the smallest id."""
    return near_dedup.keep_one(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of bounded size: a row for each piece of a document."""
    return packing.pack_best_fit(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("best_fit_packing", pack_documents),
]

#: SQL can express neither the network nor the sampling; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
