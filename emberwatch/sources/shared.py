"""The folder that driver and executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table counts as a list of settings, which is broadcast.
SETTINGS = 10_000


#: Rows of a partition where what is kept of them grows with their number.
PART_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`; a folder of our own only where it is unset and the session is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: what several readers share is worked out once, and a lost executor loses nothing of it."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *cols: str) -> DataFrame:
    """Dealt by columns to partitions of about PART_ROWS of `rows`, if the session's number of them would make them larger:
    so what a task keeps doesn't grow with the table."""
    n = -(-rows // PART_ROWS)
    return df.repartition(n, *cols) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def spread(df: DataFrame) -> DataFrame:
    """Dealt evenly to the session's number of partitions, ahead of work that is much a row: a table whose files have few row
    groups is otherwise read by as few tasks, which do all of it. A number that is asked for isn't coalesced."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def if_few(df: DataFrame) -> DataFrame:
    """With a hint to broadcast where it has SETTINGS rows at most; else the planner chooses the join."""
    return F.broadcast(df) if df.limit(SETTINGS + 1).count() <= SETTINGS else df


def settings(df: DataFrame, what: str) -> DataFrame:
    """A list of settings, to be broadcast: one of more than SETTINGS rows is an error."""
    if df.limit(SETTINGS + 1).count() > SETTINGS:
        raise ValueError(f"{what} has more than {SETTINGS} rows")
    return F.broadcast(df)
