"""Dashboards and reports over findings and scans: top and recent lists, projects with their latest scan, summaries.

Top lists are TakeOrderedAndProject; counts combine before they shuffle.  Unless said otherwise, rows with null keys form
groups of their own, ties are broken by the smallest id, repeated rows count each, and empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findinglake.domain import SEVERITIES
from findinglake.functions.columns import confidence_rank, severity_rank
from findinglake.operators.findings import active, latest


def top_by_risk(findings: DataFrame, n: int = 10) -> DataFrame:
    """Active findings with the highest risk_score (null last), then the smallest finding_id."""
    return findings.where(active()).orderBy(F.col("risk_score").desc_nulls_last(), "finding_id").limit(n)


def recent_scans(scans: DataFrame, repositories: DataFrame, n: int = 10) -> DataFrame:
    """The `n` newest scans, with their repository's name or null.  Only names of those repositories are read."""
    new = scans.orderBy(F.col("finished_at").desc_nulls_last(), F.desc("scan_id")).limit(n)
    names = repositories.select("repository_id", F.col("name").alias("repository_name"))
    names = names.join(F.broadcast(new.select("repository_id").distinct()), "repository_id", "left_semi")
    return new.join(F.broadcast(names), "repository_id", "left")


def projects_with_latest(projects: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Each project with its latest completed scan's risk (or nulls) and its active findings, riskiest first.

    Projects without a risk sort as 0, then by name.
    """
    done = latest(scans.where("status = 'COMPLETED'"), "project_id", "finished_at", "scan_id", "risk_index")
    done = done.select("project_id", F.col("finished_at").alias("last_scan_at"), "risk_index")
    counts = findings.where(active()).groupBy("project_id").agg(F.count("*").alias("open"))
    out = projects.select("project_id", "name").join(done, "project_id", "left").join(counts, "project_id", "left")
    out = out.withColumn("open", F.coalesce("open", F.lit(0)))
    return out.orderBy(F.coalesce("risk_index", F.lit(0.0)).desc(), "name")


def summary(findings: DataFrame, sections: dict[str, tuple[str, bool]]) -> DataFrame:
    """section, value, n: counts by each section's column, over all findings or the active ones; severities with 0 too.

    sections: name -> (column, active only).  One pass over the findings.
    """
    each = [
        F.struct(F.lit(name).alias("section"), F.col(c).cast("string").alias("value"), (~F.lit(live) | active()).alias("counts"))
        for name, (c, live) in sections.items()
    ]
    rows = findings.select(F.explode(F.array(*each)).alias("x")).where("x.counts")
    counts = rows.groupBy("x.section", "x.value").agg(F.count("*").alias("n"))
    zero = [(name, s) for name, (c, _) in sections.items() if c == "severity" for s in SEVERITIES]
    if not zero:
        return counts
    spark = findings.sparkSession
    none = spark.createDataFrame(zero, "section string, value string").withColumn("n", F.lit(0).cast("long"))
    return counts.unionByName(none).groupBy("section", "value").agg(F.sum("n").alias("n"))


# Why files weren't fully analysed, as reports say it.
SKIP_REASONS = {
    "SKIPPED_SIZE": "too large", "SKIPPED_BINARY": "binary", "SKIPPED_UNSUPPORTED": "unsupported type", "PARSE_ERROR": "could not be parsed",
}


def skipped_files(files: DataFrame) -> DataFrame:
    """status, n and reason of files that weren't fully analysed; other statuses aren't counted."""
    table = F.create_map(*(F.lit(x) for kv in SKIP_REASONS.items() for x in kv))
    some = files.where(F.col("status").isin(list(SKIP_REASONS))).groupBy("status").agg(F.count("*").alias("n"))
    return some.withColumn("reason", F.element_at(table, F.col("status")))


def skipped_sentence(files: DataFrame) -> DataFrame:
    """One row: the limitation that a report states on such files, in the order of their statuses; null if none is."""
    rows = F.array_sort(F.collect_list(F.struct("status", F.concat_ws(" ", F.col("n").cast("string"), "reason").alias("part"))))
    text = F.concat(F.sum("n").cast("string"), F.lit(" file(s) were not fully analysed ("), F.array_join(rows["part"], ", "), F.lit(")."))
    return skipped_files(files).agg(text.alias("limitation"))


def retest_summary(results: DataFrame, blocking_new: int = 0) -> DataFrame:
    """One row: counts of the results, those of the baseline, those that remain, and whether regressions fail it."""
    of = lambda r: F.count_if(F.col("result") == r)
    names = {
        "resolved": "RESOLVED", "still_open": "STILL_OPEN", "not_reproduced": "NOT_REPRODUCED", "not_tested": "NOT_TESTED", "new": "NEW",
        "regressions": "REGRESSION",
    }
    out = results.agg(*(of(r).alias(n) for n, r in names.items()))
    failed = (F.col("regressions") > 0) | F.lit(blocking_new > 0)
    return out.withColumns({
        "previous_findings": F.col("resolved") + F.col("still_open") + F.col("not_reproduced") + F.col("not_tested"),
        "remaining": F.col("still_open") + F.col("not_tested"),
        "regression_check": F.when(failed, "FAIL").otherwise("PASS"),
    })


def gate_severities(findings: DataFrame, by: str) -> DataFrame:
    """Per group, how many active findings that aren't false positives have each severity."""
    counted = findings.where(active() & (F.col("verification") != "FALSE_POSITIVE"))
    return counted.groupBy(by).agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in reversed(SEVERITIES)))


def page_with_total(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) in the given order, with the number of all rows as `total`."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", F.lit(df.count()).cast("long"))


def rule_levels(findings: DataFrame) -> DataFrame:
    """Per rule: title of its first finding (smallest ord), and the worst severity of all."""
    worst = F.max_by("severity", F.struct(severity_rank(F.col("severity")), F.col("severity")))
    return findings.groupBy("rule_id").agg(F.min_by("title", F.struct("ord", "title")).alias("title"), worst.alias("severity"))


def canonical_order() -> list[Column]:
    """Worst severity, then confidence, then path, line (null as 0) and rule."""
    line = F.coalesce("line", F.lit(0))
    return [severity_rank(F.col("severity")).desc(), confidence_rank(F.col("confidence")).desc(), F.col("path"), line, F.col("rule_id")]


def first_in_groups(rows: DataFrame, by: str, order: list, n: int, name: str = "place") -> DataFrame:
    """The first `n` rows of each group, with their places; partitions keep only `n` of a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn(name, place).where(F.col(name) <= n)


def risk_contributions(findings: DataFrame, by: str, risk: Column, n: int = 200) -> DataFrame:
    """The `n` findings of each group that add most to its risk, by the risk to three decimals, then by id; risk > 0."""
    rows = findings.withColumn("risk", F.round(risk.cast("decimal(38,12)"), 3).cast("double")).where("risk > 0")
    return first_in_groups(rows, by, [F.desc("risk"), "finding_id"], n).select(by, "finding_id", "risk", "place")


def finding_history(occurrences: DataFrame, n: int = 20) -> DataFrame:
    """The `n` newest occurrences of each finding (ties: path, line), with their places."""
    return first_in_groups(occurrences, "finding_id", [F.col("seen_at").desc_nulls_last(), "path", "line"], n)


def code_markers(occurrences: DataFrame, findings: DataFrame, path: str) -> DataFrame:
    """Occurrences in one file with their findings, by line (null as 0), then worst severity, then id."""
    rows = occurrences.where(F.col("path") == path).join(findings, "finding_id")
    return rows.orderBy(F.coalesce("line", F.lit(0)), severity_rank(F.col("severity")).desc(), "finding_id")
