"""SQL fragments that the queries' DuckDB versions share."""

from __future__ import annotations

from emberwatch.functions import rules as R
from emberwatch.functions import scoring as S
from emberwatch.operators import findings as O


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def any_of(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{n}')" for n in needles) + ")"


def basename(image: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({image}, '([^\\/]*)$', 1)), '\.exe$', '')"


LOLBIN = f"{basename('image')} IN {in_list(R.LOLBINS)}"
BAD_PATH = any_of("lower(image)", R.SUSPICIOUS_PATHS)
IMAGE_SEVERITY = f"CASE WHEN {LOLBIN} AND {BAD_PATH} THEN 4 WHEN {LOLBIN} OR {BAD_PATH} THEN 3 ELSE 1 END"
BAD_PORT = f"dport IN {in_list(R.SUSPICIOUS_PORTS)}"
#: Enough for the addresses of the derived view.
EXTERNAL = r"((regexp_full_match(daddr, '[0-9]+(\.[0-9]+){3}') AND NOT regexp_matches(daddr, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)')) OR daddr = '2001:db8::1')"
_LOW = "lower(path)"
WATCHED = "(" + any_of(_LOW, R.WATCH) + " AND NOT " + any_of(_LOW, [i for i in R.IGNORE if i[0] != "."]) + "".join(f" AND NOT ends_with({_LOW}, '{i}')" for i in R.IGNORE if i[0] == ".") + ")"
WRITE_RULES = [("write_to_system_dir", R.SYSTEM_DIRS), ("write_to_persistence_location", R.PERSISTENCE), ("write_to_sensitive_config", R.SENSITIVE_CONFIG)]


def rules(*pairs: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for cond, rule in pairs) + "], lambda x: x IS NOT NULL)"


PROCESS_RULES = rules((LOLBIN, "lolbin"), (BAD_PATH, "suspicious_path"), (f"{LOLBIN} AND {BAD_PATH}", "lolbin_in_suspicious_path"))
NETWORK_RULES = rules((BAD_PORT, "suspicious_port"), (f"{BAD_PORT} AND {EXTERNAL}", "suspicious_port_to_external"))
FILE_RULES = rules(*[(f"kind = 'FileWrite' AND {any_of(_LOW, dirs)}", rule) for rule, dirs in WRITE_RULES], (f"kind = 'FileOpen' AND {any_of(_LOW, R.SENSITIVE_READ)}", "read_of_sensitive_file"))
NETWORK_SEVERITY = f"CASE WHEN {BAD_PORT} AND {EXTERNAL} THEN 4 WHEN {BAD_PORT} THEN 3 ELSE 1 END"


def weight(kind: str) -> str:
    """Greatest weight of a list column `rules`."""
    cases = " ".join(f"WHEN '{r}' THEN {w}" for r, w in O.WEIGHTS[kind].items())
    return f"list_max(list_transform(rules, lambda r: CAST(CASE r {cases} ELSE {O.UNKNOWN_RULE} END AS REAL)))"


RISK = "CAST(round(CAST(100 AS REAL) * least(greatest(w * CAST(0.8 AS REAL) * CAST(0.9 AS REAL), CAST(0 AS REAL)), CAST(1 AS REAL))) AS INTEGER)"
DECISION = "CASE WHEN risk >= 70 THEN 'ACT' WHEN risk >= 40 THEN 'ATTEND' WHEN risk >= 20 THEN 'TRACK' ELSE 'DEFER' END"
SLA = f"CASE {DECISION} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SLA_HOURS.items()) + " END"


def findings(contributions: str) -> str:
    """CTEs `raw` (identity, fix, w) to `findings`, scored in the default context."""
    return f"""raw AS ({contributions}),
one AS (SELECT asset_id, vuln_id, component, location, remediation_key, max(w) AS w FROM raw GROUP BY ALL),
findings AS (SELECT asset_id || '|' || vuln_id || '|' || component || '|' || location AS finding_id, asset_id, vuln_id, component, location, risk,
  {DECISION} AS decision, CAST({SLA} AS INTEGER) AS sla_hours, 'open' AS status, remediation_key FROM (SELECT *, {RISK} AS risk FROM one) o)"""


RECORDS = f"""process_records AS (SELECT event_id, asset_id, pid, ts, image, {PROCESS_RULES} AS rules FROM sensor_events WHERE kind = 'ProcessExec'),
network_records AS (SELECT event_id, asset_id, pid, ts, daddr, dport, {NETWORK_RULES} AS rules FROM sensor_events WHERE kind = 'NetConnect'),
file_records AS (SELECT * FROM (SELECT event_id, asset_id, pid, ts, path, kind, {FILE_RULES} AS rules FROM sensor_events WHERE kind IN ('FileWrite', 'FileOpen') AND {WATCHED}) f WHERE len(rules) > 0)"""
PROCESS_RAW = f"SELECT asset_id, 'process:' || image AS vuln_id, image AS component, 'process' AS location, {weight('process')} AS w, '{O.FIXES['process']}' AS remediation_key FROM process_records WHERE len(rules) > 0"
NETWORK_RAW = f"SELECT asset_id, 'network:' || daddr || ':' || dport AS vuln_id, daddr AS component, 'network' AS location, {weight('network')} AS w, '{O.FIXES['network']}' AS remediation_key FROM network_records WHERE len(rules) > 0"
FILE_RAW = f"SELECT asset_id, 'file:' || path AS vuln_id, path AS component, path AS location, {weight('file')} AS w, '{O.FIXES['file']}' AS remediation_key FROM file_records"
ALL_RAW = f"{PROCESS_RAW} UNION ALL {NETWORK_RAW} UNION ALL {FILE_RAW}"
