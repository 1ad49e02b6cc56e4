"""A second exit without an exec between: the first exec explains events again, however long ago it was."""

import pytest
from pyspark.sql import functions as F

from emberwatch.plans import detection as D
from emberwatch.plans import stream_queries as SQ
from emberwatch.streaming import jobs as S


@pytest.fixture
def late(spark, tmp_path, monkeypatch):
    """Process 5 runs, exits, exits again more than an hour later, and connects 200 ms after that (an event is 40 ms)."""
    kinds = [(0, 5, "signup"), (100, 5, "error"), (200, 6, "signup"), (300, 6, "click"), (400, 6, "click"), (500, 6, "click"),
             (200_000, 5, "error"), (200_005, 5, "click"), (200_100, 6, "click"), (200_200, 6, "purchase")]
    rows = [(event_id, user_id, kind, '{"k": 1}') for event_id, user_id, kind in kinds]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(SQ, "SLICE", 5)
    return str(tmp_path)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_attribution_over_slices(spark, late):
    got = {r["event_id"]: r["exec_id"] for r in SQ.stream_attribution(spark, late).collect()}
    assert got[200_005] == 0 and len(got) == 6


def test_correlation_over_slices(spark, late):
    batch = D.QUERIES["correlated_activity"](spark, late)
    assert batch.where("event_id = 200005").first()["exec_id"] == 0
    assert told(SQ.stream_correlation(spark, late).select(*batch.columns)) == told(batch)


def test_chains_alone(spark, sf):
    """The stream of chains alone has those of the batch, and is asked for no single records."""
    got = SQ.stream_chains(spark, sf)
    chains = D.QUERIES["dropper_chains"](spark, sf).unionByName(D.QUERIES["exfil_chains"](spark, sf))
    assert told(got) == told(chains.select(*got.columns)) and not got.isEmpty()


def test_epochs_of_two_execs_side_by_side():
    """An event that a late exec explains doesn't end the epoch of the exec before."""
    row = lambda kind, ts, event_id: {"kind": kind, "ts": ts, "event_id": event_id}
    epochs = {}
    half = lambda r, exec_id: S.Correlation._half(epochs, "exfil", r, exec_id)
    assert half(row("FileOpen", 0, 10), 1) is None and half(row("FileOpen", 10, 11), 2) is None
    assert half(row("NetConnect", 20, 12), 1) == (10, 12) and half(row("NetConnect", 30, 13), 1) is None
    assert half(row("NetConnect", 40, 14), 2) == (11, 14)
    assert half(row("FileOpen", 5040, 15), 1) is None and len(epochs) == 1  # what can't grow any more is gone


class Row(dict):
    asked = 0

    def __getitem__(self, name):
        Row.asked += 1
        return dict.__getitem__(self, name)


def test_rows_of_a_busy_process_are_not_compared_with_each_other():
    n, busy = 2000, S.Attribution()
    busy.touch = lambda pid, ts: {}
    rows = [Row(event_id=k, kind="FileOpen", ts=k * 300, image="", asset_id="h", pid=1) for k in range(n)]
    assert len(busy.ready(("h", 1), rows, [])) == n
    assert Row.asked < 20 * n
