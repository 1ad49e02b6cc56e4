"""Small helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a line key: blank, tab, line feed, vertical tab, form feed, carriage return.
STRIP = " \t\n\x0b\x0c\r"
#: Rows up to which a small table is broadcast.
BROADCAST_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. A join with the result has a plain exchange on that side,
    so that adaptive execution can split a hot key of the other side."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a variant of it that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` of a value that is worked out once a row. What a function over an array's elements captures is worked out for
    each element, unless it is a variable such as this."""
    return F.get(F.transform(F.array(value), lambda v: of(v)), F.lit(0))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Recent(dict):
    """A dictionary of the `size` last new entries at least and twice as many at most: when it is full, it becomes the
    older half, from which what is asked for again comes back."""

    def __init__(self, size: int) -> None:
        super().__init__()
        self.size, self.older = size, {}

    def recall(self, key):
        """For a key that isn't among the newer ones."""
        value = self.older.get(key)
        if value is not None:
            self.add(key, value)
        return value

    def add(self, key, value) -> None:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        self[key] = value
