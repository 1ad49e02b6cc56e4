"""Analytics over remediation logs. Nothing here acts on a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Legal transitions, and what roles may do.
EDGES = {
    "drafted": ["mapped", "dry_run"], "mapped": ["dry_run"], "dry_run": ["pending_approval"],
    "pending_approval": ["approved", "aborted"], "approved": ["canary"], "canary": ["canary_verify", "rolled_back"],
    "canary_verify": ["rollout", "rolled_back"], "rollout": ["verify", "rolled_back"],
    "verify": ["closed", "rolled_back"], "rollback_incomplete": ["rolled_back"],
}
ABORTABLE = ["drafted", "mapped", "dry_run", "pending_approval", "approved", "canary", "canary_verify", "rollout", "verify"]
PERMITS = {
    "admin": ["draft", "submit", "approve", "reject", "canary", "rollout", "rollback", "abort"],
    "operator": ["draft", "submit", "canary", "rollout", "rollback"], "approver": ["approve", "reject"], "responder": ["abort"],
}


def current_state(audit: DataFrame) -> DataFrame:
    """Per action the target of its last transition that wasn't rejected, by sequence number."""
    return audit.where("outcome <> 'rejected' AND from_state IS NOT NULL").groupBy("action_id").agg(F.max_by("to_state", "seq").alias("state"), F.max("seq").alias("seq"))


def illegal_transitions(audit: DataFrame) -> DataFrame:
    """Accepted transitions that the state machine doesn't have, or that don't start where the action was."""
    w = Window.partitionBy("action_id").orderBy("seq")
    t = audit.where("outcome <> 'rejected' AND from_state IS NOT NULL").withColumn("was", F.lag("to_state").over(w))
    legal = F.lit(False)
    for a, bs in EDGES.items():
        legal = legal | ((F.col("from_state") == a) & F.col("to_state").isin(bs))
    legal = legal | ((F.col("to_state") == "aborted") & F.col("from_state").isin(ABORTABLE))
    broken = F.col("was").isNotNull() & (F.col("was") != F.col("from_state"))
    return t.where(~legal | broken).select("action_id", "seq", "was", "from_state", "to_state")


def stage_failures(results: DataFrame, threshold: float) -> DataFrame:
    """Per action and stage the share of failed applies; above the threshold the stage rolls back."""
    g = results.groupBy("action_id", "stage").agg(F.count("*").alias("attempted"), F.count_if("failed").alias("failed"))
    rate = F.when(F.col("attempted") > 0, F.col("failed") / F.col("attempted")).otherwise(F.lit(0.0))
    return g.withColumns({"rate": rate, "rolled_back": rate > threshold})


def canary_cohort(targets: Column, cohort: Column) -> Column:
    """The first targets: the cohort's size, one at least, all at most."""
    return F.slice(targets, 1, F.least(F.greatest(cohort, F.lit(1)), F.size(targets)).cast("int"))


def remaining_targets(targets: Column, applied: Column) -> Column:
    return F.filter(targets, lambda t: ~F.array_contains(applied, t))


def schedule_status(not_before: Column, not_after: Column, now: Column) -> Column:
    return F.when(now > not_after, "expired").when(now < not_before, "pending").otherwise("open")


def unauthorized_commands(commands: DataFrame, roles: DataFrame) -> DataFrame:
    """Commands whose actor has no role, or one that doesn't permit the kind."""
    allowed = F.lit(False)
    for role, kinds in PERMITS.items():
        allowed = allowed | ((F.col("role") == role) & F.col("kind").isin(kinds))
    return commands.join(roles, "actor", "left").where(~F.coalesce(allowed, F.lit(False)))


def replay_audit(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds `accepted`: the sequence number is above the session's opening value and above all before it. An unknown
    session accepts nothing. Order of arrival: `arrival`. What is above all accepted ones is above all seen, since a
    number is accepted exactly if it is above these."""
    before = Window.partitionBy("session").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    j = commands.join(sessions, "session", "left")
    floor = F.greatest(F.col("open_from"), F.coalesce(F.max("seq").over(before), F.col("open_from")))
    return j.withColumn("accepted", F.coalesce(F.col("open_from").isNotNull() & (F.col("seq") > floor), F.lit(False)))


def match_results(commands: DataFrame, results: DataFrame) -> DataFrame:
    """Commands (session, seq) with their results: the first is accepted, repeats and those without a command are
    flagged, and commands without any are outstanding."""
    w = Window.partitionBy("session", "seq").orderBy("arrival")
    r = results.withColumn("nth", F.row_number().over(w))
    j = commands.select("session", "seq", F.lit(True).alias("issued")).join(r, ["session", "seq"], "full_outer")
    status = F.when(F.col("nth").isNull(), "outstanding").when(F.col("issued").isNull(), "unknown").when(F.col("nth") > 1, "repeat").otherwise("accepted")
    return j.select("session", "seq", "arrival", status.alias("status"))


def verify_fixes(links: DataFrame, findings: DataFrame) -> DataFrame:
    """Per action: fixed if none of its linked findings is found any more on its targets. Without a link it is not fixed.
    `links`: action_id, finding_id (null for none)."""
    open_ = findings.select("finding_id").distinct().withColumn("still", F.lit(1))
    j = links.join(open_, "finding_id", "left")
    return j.groupBy("action_id").agg(F.count("finding_id").alias("linked"), F.count("still").alias("remaining")).withColumn("fixed", (F.col("linked") > 0) & (F.col("remaining") == 0))
