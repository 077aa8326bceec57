"""Operators over findings: filters, counts, rankings, risk, policy, identity, comparison of scans.

A finding has finding_id, project_id, severity, status, confidence, exploitability, verification, first_seen_at and
resolved_at.  All operators are DataFrame expressions; group-bys combine before they shuffle, and top lists are
TakeOrderedAndProject, so no result passes one task whole.  Unless said otherwise, rows with a null key form a group of
their own, null values are unknown ones (lowest rank), ties go to the smallest id, repeated rows count each, and an
empty table gives an empty table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findinglake.domain import ACTIVE, RETEST_ORDER, SATURATION, SEVERITIES, UNKNOWN_WEIGHT, WEIGHTS
from findinglake.functions.columns import confidence_rank, digest, lookup, normalise_code, rank, severity_rank
from findinglake.operators.numbering import last_before, numbered


def active() -> Column:
    return F.col("status").isin(ACTIVE)


def filtered(findings: DataFrame, active_only: bool = False, contains: str | None = None, text_columns=(), **values) -> DataFrame:
    """Rows that meet all given conditions: column=value or a list of values; None is no condition.

    contains: a term of at most 200 characters, looked for in any of text_columns without regard to case; % and _ in
    it are removed.
    """
    out = findings.where(active()) if active_only else findings
    for name, want in values.items():
        if want is not None:
            out = out.where(F.col(name).isin(list(want)) if isinstance(want, list | tuple | set) else F.col(name) == want)
    term = (contains or "").strip()[:200].replace("%", "").replace("_", "")
    if term and text_columns:
        hit = F.lit(False)
        for c in text_columns:
            hit = hit | F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
        out = out.where(hit)
    return out


def visible_projects(projects: DataFrame, members: DataFrame, user_id: int, org_wide: bool) -> DataFrame:
    """All projects for an organisation-wide role, else those of which the user is a member."""
    mine = members.where(F.col("user_id") == user_id).select("project_id")
    return projects if org_wide else projects.join(mine, "project_id", "left_semi")


def severity_sorted(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.col("risk_score").desc_nulls_last(), "finding_id")


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of a sorted table."""
    return df.offset((number - 1) * size).limit(size)


def open_by_severity(findings: DataFrame) -> DataFrame:
    """Active findings of each severity; severities without any stand with 0."""
    spark = findings.sparkSession
    dim = spark.range(1).select(F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity"))
    counts = findings.where(active()).groupBy("severity").agg(F.count("*").alias("n"))
    return dim.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def grouped(findings: DataFrame, column: str, active_only: bool = True) -> DataFrame:
    return filtered(findings, active_only).groupBy(column).agg(F.count("*").alias("n"))


def severity_by_project(findings: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return findings.where(active()).groupBy("project_id").agg(F.count("*").alias("open"), *map(of, reversed(SEVERITIES)))


def top_classes(occurrences: DataFrame, n: int = 10) -> DataFrame:
    counts = occurrences.groupBy("vuln_class").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "vuln_class").limit(n)


def daily_trend(findings: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """New and resolved findings of each of the last `days` days; the first day begins at as_of's time of day."""
    since = as_of - dt.timedelta(days=days - 1)
    calendar = findings.sparkSession.range(days).select(F.date_add(F.lit(since.date()), F.col("id").cast("int")).alias("day"))

    def per_day(rows: DataFrame, column: str, name: str) -> DataFrame:
        rows = rows.where((F.col(column) >= F.lit(since)) & (F.col(column) < F.lit(as_of.date() + dt.timedelta(days=1))))
        return rows.groupBy(F.to_date(column).alias("day")).agg(F.count("*").alias(name))

    new = per_day(findings, "first_seen_at", "new")
    resolved = per_day(findings.where("status = 'RESOLVED'"), "resolved_at", "resolved")
    both = calendar.join(new, "day", "left").join(resolved, "day", "left")
    return both.select("day", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("resolved", F.lit(0)).alias("resolved"))


def mttr_days(findings: DataFrame, as_of: dt.datetime, days: int = 90) -> DataFrame:
    """Mean days to resolve over the last `days` days; rows without a time add 0 but count.  Null without rows."""
    rows = findings.where((F.col("status") == "RESOLVED") & (F.col("resolved_at") >= F.lit(as_of - dt.timedelta(days=days))))
    took = F.unix_timestamp(F.col("resolved_at").cast("timestamp")) - F.unix_timestamp(F.col("first_seen_at").cast("timestamp"))
    return rows.agg(F.round(F.sum(F.coalesce(took, F.lit(0))) / F.count("*") / 86400, 1).alias("mttr_days"))


def risk_history(scans: DataFrame, n: int = 60) -> DataFrame:
    done = scans.where("status = 'COMPLETED' and risk_index is not null")
    return done.select("scan_id", "project_id", "risk_index", "finished_at").orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(n)


def hotspots(occurrences: DataFrame, findings: DataFrame, n: int = 10) -> DataFrame:
    """Files with the worst active findings: worst severity, then count, then path."""
    live = findings.where(active()).select("finding_id", "severity")
    rows = occurrences.select("finding_id", "path").join(live, "finding_id")
    worst = F.max(severity_rank(F.col("severity")))
    out = rows.groupBy("path").agg(F.count("*").alias("n"), worst.alias("worst"))
    out = out.orderBy(F.desc("worst"), F.desc("n"), "path").limit(n)
    return out.select("path", "n", F.element_at(F.lit(SEVERITIES), F.col("worst") + 1).alias("severity"))


def file_stats(files: DataFrame) -> DataFrame:
    """Files and characters by language, by source, and in all."""
    return files.groupingSets([["language"], ["source"], []], "language", "source").agg(
        F.count("*").alias("files"), F.sum("size").alias("size"), F.grouping_id().cast("long").alias("level")
    )


def latest(rows: DataFrame, key: str, time: str, tie: str, *columns: str) -> DataFrame:
    """The latest row of each key (nulls last, ties: largest), as a grouped maximum: no sort, combined before the shuffle."""
    best = F.max(F.struct(F.col(time), F.col(tie), *(c for c in columns if c not in (time, tie)))).alias("x")
    return rows.groupBy(key).agg(best).select(key, *(F.col(f"x.{c}") for c in dict.fromkeys((time, tie, *columns))))


def default_baseline(scans: DataFrame) -> DataFrame:
    """For each scan, the latest completed scan before it in the same project (null: none), by finished_at, then scan_id."""
    done = F.when(F.col("status") == "COMPLETED", F.col("scan_id"))
    return last_before(scans, "project_id", "finished_at", "scan_id", done, "baseline_id").select("scan_id", "baseline_id")


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in the ascending order of some columns, nulls first; of equal ones any.

    Rows are reduced before they are shuffled, so a key with a third of all rows is no task's burden.
    """
    place = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)))
    whole = F.struct(*(F.col(c) for c in rows.columns))
    return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(whole, place).alias("row")).select("row.*")


def public_ids(findings: DataFrame, prefix: str = "FL") -> DataFrame:
    """Numbers per project in the canonical order: worst severity, then confidence, then id."""
    order = {"severity": -severity_rank(F.col("severity")), "confidence": -confidence_rank(F.col("confidence"))}
    rows = numbered(findings.select("finding_id", "project_id", "severity", "confidence"), "project_id", order, "finding_id")
    return rows.select("finding_id", "project_id", F.format_string(f"{prefix}-%03d", "nth").alias("public_id"))


def proven_supersedes(hits: DataFrame, keys: list[str], proven: Column) -> DataFrame:
    """Unproven hits go where a hit of the same keys is proven."""
    yes = F.coalesce(proven, F.lit(False))
    known = hits.where(yes).select(*keys).distinct()
    return hits.where(yes).unionByName(hits.where(~yes).join(known, keys, "left_anti").select(*hits.columns))


def merged_weights(overrides: dict | None = None) -> tuple[dict, float]:
    """Default weights with valid overrides: known names, 0 to 100; saturation 1 to 10,000.  Others have no effect."""
    weights = {k: dict(v) for k, v in WEIGHTS.items()}
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    for factor, table in (overrides or {}).items():
        if factor in weights and isinstance(table, dict):
            weights[factor] |= {k: float(v) for k, v in table.items() if k in weights[factor] and number(v) and 0 <= v <= 100}
    k = (overrides or {}).get("saturation")
    return weights, float(k) if number(k) and 1 <= k <= 10_000 else SATURATION


def finding_risk(overrides: dict | None = None, ignore_status: bool = False, optional: tuple[str, ...] = ()) -> Column:
    """The product of a finding's factors; `optional` names factors (exposure, business_criticality) that rows have."""
    weights, _ = merged_weights(overrides)
    names = ["severity", "confidence", "exploitability", "verification", *optional, *(() if ignore_status else ("status",))]
    out = F.lit(1.0)
    for f in names:
        out = out * lookup(F.col(f), weights[f], UNKNOWN_WEIGHT.get(f, 1.0))
    return out


def risk_index(findings: DataFrame, by: str, overrides: dict | None = None, optional: tuple[str, ...] = ()) -> DataFrame:
    """Per group: 100 * (1 - e^(-sum / saturation)) with one decimal, and the risk that was accepted."""
    _, k = merged_weights(overrides)
    accepted = F.when(F.col("status") == "ACCEPTED_RISK", finding_risk(overrides, True, optional)).otherwise(0.0)
    # Decimals: their sums don't depend on order, and halves are rounded up.
    total = lambda c: F.sum(c.cast("decimal(38,12)"))
    out = findings.groupBy(by).agg(total(finding_risk(overrides, False, optional)).alias("t"), total(accepted).alias("a"))
    index = F.when(F.col("t") > 0, F.round(100 * (1 - F.exp(-F.col("t").cast("double") / k)), 1)).otherwise(0.0)
    three = lambda c: F.round(c, 3).cast("double")
    return out.select(by, index.alias("risk_index"), three("t").alias("total_risk"), three("a").alias("accepted_risk"))


def gate(
    findings: DataFrame, by: str, fail_on=("CRITICAL", "HIGH"), min_confidence: str = "MEDIUM", include_ai: bool = False,
    max_findings: int | None = None,
) -> DataFrame:
    """Per group: blocking findings, counted ones, and PASS or FAIL."""
    counted = active() & (F.col("verification") != "FALSE_POSITIVE")
    blocking = counted & F.col("severity").isin(list(fail_on)) & (confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(min_confidence)))
    if not include_ai:
        blocking = blocking & (F.col("verification") != "AI_SUGGESTED")
    out = findings.groupBy(by).agg(F.count_if(blocking).alias("blocking"), F.count_if(counted).alias("counted"))
    over = F.lit(False) if max_findings is None else F.col("counted") > max_findings
    return out.withColumn("gate", F.when((F.col("blocking") > 0) | over, "FAIL").otherwise("PASS"))


def fingerprint_code(engine: Column, vuln_class: Column, path: Column, function: Column, snippet: Column) -> Column:
    """A code finding's identity: no line numbers, so moved code keeps it."""
    return digest(engine, vuln_class, path, function, normalise_code(snippet))


def compare_scans(baseline: DataFrame, current: DataFrame, history: DataFrame, partial: bool = False) -> DataFrame:
    """fingerprint and result of each finding of either scan, by exact identity.

    baseline, current: fingerprint, path, scanner; history: fingerprints resolved before.  One current row answers one
    baseline row; more baseline rows of the fingerprint fall through.  A baseline finding whose path wasn't analysed
    is NOT_TESTED (partial scans) or NOT_REPRODUCED, and NOT_TESTED if its scanner didn't run.
    """
    numbered = Window.partitionBy("fingerprint").orderBy("path", "scanner")
    old = baseline.withColumn("nth", F.row_number().over(numbered))
    now = first_of(current, ["fingerprint"], "path", "scanner").withColumn("nth", F.lit(1))
    paths = current.select("path").distinct().withColumn("analysed", F.lit(True))
    ran = current.select(F.split_part("scanner", F.lit(":"), F.lit(1)).alias("base")).distinct().withColumn("ran", F.lit(True))
    both = old.select("fingerprint", "nth", "path", F.split_part("scanner", F.lit(":"), F.lit(1)).alias("base")).join(
        now.select("fingerprint", "nth", F.lit(True).alias("found")), ["fingerprint", "nth"], "left"
    )
    gone = F.when(F.col("path").isNotNull() & F.col("analysed").isNull(), "NOT_TESTED" if partial else "NOT_REPRODUCED")
    gone = gone.when(F.col("ran").isNull(), "NOT_TESTED").otherwise("RESOLVED")
    known = both.join(paths, "path", "left").join(ran, "base", "left")
    known = known.select("fingerprint", F.when(F.col("found"), "STILL_OPEN").otherwise(gone).alias("result"))
    fresh = now.select("fingerprint").join(old.select("fingerprint"), "fingerprint", "left_anti")
    before = history.select("fingerprint").distinct().withColumn("was", F.lit(True))
    fresh = fresh.join(before, "fingerprint", "left")
    return known.unionByName(fresh.select("fingerprint", F.when(F.col("was"), "REGRESSION").otherwise("NEW").alias("result")))


def retest_sorted(results: DataFrame) -> DataFrame:
    return results.orderBy(rank(F.col("result"), RETEST_ORDER), "fingerprint")
