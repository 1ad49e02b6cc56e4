"""Components of hosts: as many partitions as the table's rows need, and the same rows."""

import re

from pyspark.sql import functions as F

from emberwatch import fixtures
from emberwatch.sources import shared


def test_partitions_follow_the_rows(spark, sf, monkeypatch):
    whole = fixtures.sbom_components(spark, sf)
    monkeypatch.setattr(shared, "PART_ROWS", 500, raising=False)
    split = fixtures.sbom_components(spark, sf)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    counts = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", split._jdf.queryExecution().executedPlan().toString())]
    assert counts == [-(-rows // 500)]
    told = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert told(split) == told(whole) == sorted(set(told(whole)), key=str)
    assert whole.where(F.col("asset_id").isNull()).isEmpty()
