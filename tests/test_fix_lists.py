"""A fix tells which vulnerabilities it closes, not only how many."""

from emberwatch.operators import findings as O
from emberwatch.plans import feed_queries as FQ


def test_a_fix_lists_what_it_closes(spark):
    rows = [("f", 5, "v2", "a", "open"), ("f", 9, "v1", "a", "open"), ("f", 1, "v1", "b", "open"), ("f", 1, "v3", "c", "suppressed"), ("g", 7, "v2", "a", "open")]
    q = O.fix_queue(spark.createDataFrame(rows, "remediation_key string, risk int, vuln_id string, asset_id string, status string"), closes=True)
    assert [(r["remediation_key"], r["risk"], r["closes"], r["closes_count"], r["assets_count"], r["findings"]) for r in q.collect()] == [("f", 9, ["v1", "v2"], 2, 2, 3), ("g", 7, ["v2"], 1, 1, 1)]


def test_the_query_has_the_lists(spark, sf):
    known = {r["vuln_id"] for r in FQ._vulnerability_run(spark, sf)[0].where("status <> 'suppressed'").select("vuln_id").distinct().collect()}
    got = [v for r in FQ.vulnerability_fixes(spark, sf).collect() for v in r["closes"].split(",")]
    assert known and set(got) == known
