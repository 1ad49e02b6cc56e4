"""Reports of detection quality on made-up cases."""

import random

import pytest

from emberwatch.operators import scorecard


@pytest.mark.parametrize("most", [3, 100_000, 1 << 61])
def test_latency_by_class(spark, most):
    """Ranks of small, equal and very large latencies, without an array of all of a class's cases."""
    rng = random.Random(most)
    size = {1007: 401, 4001: 40, 5001: 1, 5002: 2}
    ms = {c: [rng.randrange(most) for _ in range(n)] for c, n in size.items()}
    rows = [(k, c, v) for k, (c, v) in enumerate((c, v) for c in ms for v in ms[c])]
    cases = spark.createDataFrame([(k, c, "r") for k, c, _ in rows], "case_id long, want_class int, want_rule string")
    captures = spark.createDataFrame([(k, 1000) for k, *_ in rows], "case_id long, trigger long")
    records = spark.createDataFrame([(k, c, v + 1000, ["r"]) for k, c, v in rows], "case_id long, class_uid int, time long, rules array<string>")
    out = scorecard.latency_by_class(cases, captures, records)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    got = {r["class_uid"]: (r["n"], r["median_ms"], r["p95_ms"]) for r in out.collect()}
    want = {}
    for c, v in ms.items():
        v, n = sorted(v), len(v)
        want[c] = (n, (v[(n - 1) // 2] + v[n // 2]) // 2, v[int(0.95 * (n - 1) + 0.5)])
    assert got == want
    assert scorecard.latency_by_class(cases.limit(0), captures, records).count() == 0
