"""States of findings and scans: changes by hand with their rules, persistent numbers, remediations, results of retests.

Changes are judged as joins of requests with the state before them, one request for each finding.  Rows that break a
rule keep the old state and say why.  Null statuses count as no known one; repeated requests are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findinglake.domain import ACTIVE, ROLES
from findinglake.functions.columns import rank
from findinglake.operators.numbering import numbered

# Statuses and verifications that only scans set, and statuses that need a triage role and a reason.
_NOT_BY_HAND = {"status": ["REOPENED"], "verification": ["AI_SUGGESTED", "NOT_TESTED"]}
_TRIAGE = ["FALSE_POSITIVE", "ACCEPTED_RISK", "RESOLVED"]


def _triage(role: Column) -> Column:
    return rank(role, ROLES) >= ROLES.index("SECURITY_ANALYST")


def _said(reason: Column) -> Column:
    return F.coalesce(F.trim(reason), F.lit("")) != ""


def change_status(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """finding_id, status, verification, resolved_at and error after requests (finding_id, new_status, role, reason, at).

    REOPENED isn't set by hand; false positives, accepted risks and resolved findings need a triage role, then a
    reason.  Resolving sets resolved_at, leaving RESOLVED clears it; a false positive is so verified, and a finding
    that ceases to be one is DETECTED again.  error is null where the change took place.
    """
    new, old = F.col("new_status"), F.col("status")
    triage = new.isin(_TRIAGE)
    error = F.when(new.isin(_NOT_BY_HAND["status"]), "invalid_status").when(triage & ~_triage(F.col("role")), "forbidden")
    error = error.when(triage & ~_said(F.col("reason")), "reason_required")
    rows = findings.join(requests, "finding_id").withColumn("error", error)
    done = F.col("error").isNull()
    back = (old == "FALSE_POSITIVE") & (F.col("verification") == "FALSE_POSITIVE")
    verification = F.when(new == "FALSE_POSITIVE", "FALSE_POSITIVE").when(back, "DETECTED").otherwise(F.col("verification"))
    resolved = F.when(new == "RESOLVED", F.col("at")).when(old == "RESOLVED", None).otherwise(F.col("resolved_at"))
    return rows.select(
        "finding_id", F.when(done, new).otherwise(old).alias("status"),
        F.when(done, verification).otherwise(F.col("verification")).alias("verification"),
        F.when(done, resolved).otherwise(F.col("resolved_at")).alias("resolved_at"), "error",
    )


def change_verification(findings: DataFrame, requests: DataFrame) -> DataFrame:
    """finding_id, status, verification and error after requests (finding_id, new_verification, role, reason).

    It needs a triage role; AI_SUGGESTED and NOT_TESTED aren't set by hand; CONFIRMED and FALSE_POSITIVE need a
    reason.  FALSE_POSITIVE sets the status too, and another verification opens a false positive again.
    """
    new, old = F.col("new_verification"), F.col("status")
    error = F.when(~_triage(F.col("role")), "forbidden").when(new.isin(_NOT_BY_HAND["verification"]), "invalid_verification")
    error = error.when(new.isin("CONFIRMED", "FALSE_POSITIVE") & ~_said(F.col("reason")), "reason_required")
    rows = findings.join(requests, "finding_id").withColumn("error", error)
    done = F.col("error").isNull()
    status = F.when(new == "FALSE_POSITIVE", "FALSE_POSITIVE").when(old == "FALSE_POSITIVE", "OPEN").otherwise(old)
    return rows.select(
        "finding_id", F.when(done, status).otherwise(old).alias("status"),
        F.when(done, new).otherwise(F.col("verification")).alias("verification"), "error",
    )


# Which status of a scan may follow which.
_NEXT = {"QUEUED": ["RUNNING", "CANCELLED"], "RUNNING": ["COMPLETED", "FAILED", "CANCELLED"]}


def scan_transitions(events: DataFrame, by: str = "scan_id") -> DataFrame:
    """events (by, at, ord, status) with the status before (null: none) and whether it may follow; scans begin QUEUED."""
    before = F.lag("status").over(Window.partitionBy(by).orderBy("at", "ord"))
    rows = events.withColumn("before", before)
    allowed = F.when(F.col("before").isNull(), F.col("status") == "QUEUED").otherwise(F.lit(False))
    for old, new in _NEXT.items():
        allowed = allowed | F.coalesce((F.col("before") == old) & F.col("status").isin(new), F.lit(False))
    return rows.withColumn("allowed", F.coalesce(allowed, F.lit(False)))


def persistent_numbers(existing: DataFrame, incoming: DataFrame, unique: str = "ord") -> DataFrame:
    """project_id, fingerprint, number: known fingerprints keep theirs, new ones go on from the project's largest.

    existing: project_id, fingerprint, number.  incoming: project_id, fingerprint and `unique`, whole numbers in the
    order in which findings came; of equal fingerprints the first counts.
    """
    first = incoming.groupBy("project_id", "fingerprint").agg(F.min(unique).alias(unique))
    known = first.join(existing, ["project_id", "fingerprint"]).select("project_id", "fingerprint", "number")
    new = first.join(existing, ["project_id", "fingerprint"], "left_anti")
    last = existing.groupBy("project_id").agg(F.max("number").alias("last"))
    new = numbered(new, "project_id", {}, unique).join(last, "project_id", "left")
    return known.unionByName(new.select("project_id", "fingerprint", (F.coalesce("last", F.lit(0)) + F.col("nth")).alias("number")))


def retest_rows(items: DataFrame, findings: DataFrame, fail_on: list[str], at) -> DataFrame:
    """finding_id, result, status and resolved_at after a retest, and whether it is a new blocking one.

    items: finding_id, result, ord, severity.  Of a finding's items the first counts.  RESOLVED and NOT_REPRODUCED
    resolve active findings; REGRESSION reopens.
    """
    one = items.groupBy("finding_id").agg(F.min_by(F.struct("result", F.col("severity").alias("found")), "ord").alias("x"))
    rows = findings.join(one.select("finding_id", "x.*"), "finding_id")
    gone = F.col("result").isin("RESOLVED", "NOT_REPRODUCED") & F.col("status").isin(ACTIVE)
    status = F.when(gone, "RESOLVED").when(F.col("result") == "REGRESSION", "REOPENED").otherwise(F.col("status"))
    return rows.select(
        "finding_id", "result", status.alias("status"), F.when(gone, F.lit(at)).otherwise(F.col("resolved_at")).alias("resolved_at"),
        ((F.col("result") == "NEW") & F.col("found").isin(fail_on)).alias("new_blocking"),
    )


def verified_remediations(remediations: DataFrame, results: DataFrame) -> DataFrame:
    """remediations (remediation_id, finding_id, status) with their outcome after a retest's results (finding_id, result).

    Of APPLIED ones, those whose finding is RESOLVED are VERIFIED, those with another result NOT_VERIFIED; without a
    result nothing changes, and the outcome is NOT_TESTED.
    """
    out = remediations.join(results.select("finding_id", "result"), "finding_id", "left")
    applied = F.col("status") == "APPLIED"
    status = F.when(applied & (F.col("result") == "RESOLVED"), "VERIFIED").when(applied & F.col("result").isNotNull(), "NOT_VERIFIED")
    outcome = F.when(applied, F.coalesce("result", F.lit("NOT_TESTED")))
    return out.select("remediation_id", "finding_id", F.coalesce(status, F.col("status")).alias("status"), outcome.alias("retest_result"))


def regression_history(history: DataFrame, resolved: DataFrame, current: DataFrame, most: int = 5000) -> DataFrame:
    """The fingerprints resolved before or now that aren't current, in order, at most `most` of them (a report's limit)."""
    all_ = history.select("fingerprint").union(resolved.select("fingerprint")).distinct()
    return all_.join(current.select("fingerprint"), "fingerprint", "left_anti").orderBy("fingerprint").limit(most)


def policy_of(projects: DataFrame, project_policies: DataFrame, organization_policies: DataFrame, default: Column) -> DataFrame:
    """project_id and its policy: its own, else its organization's, else the default."""
    own = project_policies.select("project_id", F.col("policy").alias("own"))
    wide = organization_policies.select("organization_id", F.col("policy").alias("wide"))
    rows = projects.join(own, "project_id", "left").join(F.broadcast(wide), "organization_id", "left")
    return rows.select("project_id", F.coalesce("own", "wide", default).alias("policy"))


def introduced(findings: DataFrame, results: DataFrame) -> DataFrame:
    """The findings that a comparison with the baseline calls NEW or REGRESSION: those that its gate looks at."""
    new = results.where(F.col("result").isin("NEW", "REGRESSION")).select("fingerprint")
    return findings.join(new, "fingerprint", "left_semi")
