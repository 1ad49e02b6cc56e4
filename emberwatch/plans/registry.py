"""Queries by name, and their SQL."""

from emberwatch.plans import detection, feed_queries, inventory_queries, posture_reports, record_queries, stream_queries, vulnerability

QUERIES, SQL = {}, {}
for _m in (detection, vulnerability, posture_reports, inventory_queries, record_queries, feed_queries, stream_queries):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
