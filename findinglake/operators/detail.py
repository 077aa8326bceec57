"""A finding in full, stored findings as a scan saw them, and what changed between two scans.

Lists within a row are bounded: only the newest entries of a finding reach its row, and partitions keep no more of a
finding before the shuffle, so one with millions of occurrences costs what others do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.operators.dashboard import first_in_groups

SNAPSHOT = ["severity", "confidence", "rule_id", "path", "line", "snippet"]


def newest(rows: DataFrame, by: str, order: list, columns: list[str], n: int, name: str) -> DataFrame:
    """by and an array of the first `n` rows (structs of columns) of each group, in order."""
    few = first_in_groups(rows.where(F.col(by).isNotNull()), by, order, n, "_place")
    listed = F.sort_array(F.collect_list(F.struct("_place", F.struct(*columns).alias("x"))))
    return few.groupBy(by).agg(F.transform(listed, lambda e: e["x"]).alias(name))


def finding_details(findings: DataFrame, occurrences: DataFrame, retests: DataFrame, seen: int = 20, tested: int = 50) -> DataFrame:
    """Each finding's columns with its `seen` newest occurrences and `tested` newest retest results; empty lists if none.

    findings: finding_id, unique.  occurrences: finding_id, seen_at, path, line, scanner, snippet.  retests: finding_id,
    created_at, retest_id, result.  Null times are oldest, ties go by the other columns.  Rows of no finding are left out.
    """
    where = ["path", "line", "scanner", "snippet"]
    seen_at = [F.col("seen_at").desc_nulls_last(), *where]
    o = newest(occurrences, "finding_id", seen_at, ["seen_at", *where], seen, "occurrences")
    at = [F.col("created_at").desc_nulls_last(), "retest_id", "result"]
    r = newest(retests, "finding_id", at, ["created_at", "retest_id", "result"], tested, "retests")
    out = findings.join(o, "finding_id", "left").join(r, "finding_id", "left")
    for name, kind in (("occurrences", o.schema["occurrences"]), ("retests", r.schema["retests"])):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind.dataType)))
    return out


def seen_by_scan(findings: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Stored findings as scans saw them: the finding's identity and class with the place of each of its occurrences.

    findings: finding_id, fingerprint, rule_id, engine, vuln_class, title, severity, confidence, path.  occurrences:
    scan_id, finding_id, path, line, end_line, function, snippet, scanners.  A place without path has the finding's,
    then an empty one; null scanners are none.
    """
    f = findings.select(
        "finding_id", "fingerprint", "rule_id", "engine", "vuln_class", "title", "severity", "confidence", F.col("path").alias("_path")
    )
    o = occurrences.select("scan_id", "finding_id", "path", "line", "end_line", "function", "snippet", "scanners")
    out = o.join(f, "finding_id").withColumn("path", F.coalesce("path", "_path", F.lit(""))).drop("_path")
    return out.withColumn("scanners", F.coalesce("scanners", F.array().cast("array<string>")))


def baseline_rows(findings: DataFrame, occurrences: DataFrame, scans: DataFrame) -> DataFrame:
    """seen_by_scan of the baseline of each scan (scan_id, baseline_scan_id; no row for scans without): with for_scan."""
    pairs = scans.where("baseline_scan_id is not null").select(F.col("scan_id").alias("for_scan"), F.col("baseline_scan_id").alias("scan_id"))
    return seen_by_scan(findings, occurrences.join(pairs.select("scan_id").distinct(), "scan_id", "left_semi")).join(pairs, "scan_id")


def one_of_each_dependency(dependencies: DataFrame, order: list[str]) -> DataFrame:
    """The first row, by `order`, of each scan's ecosystem, name, version and manifest; nulls are equal to each other."""
    key = ["scan_id", "ecosystem", "name", "version", "manifest_path"]
    rest = [c for c in dependencies.columns if c not in key]
    first = dependencies.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return first.select(*key, "x.*").select(*dependencies.columns)


def _one(rows: DataFrame, name: str) -> DataFrame:
    """One row for each fingerprint, the first by place, as a struct."""
    place = [F.coalesce("path", F.lit("")), F.coalesce("line", F.lit(0)), F.coalesce("rule_id", F.lit(""))]
    order: Column = F.struct(*place, *(F.coalesce(F.col(c), F.lit("")) for c in ("severity", "confidence", "snippet")))
    return rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.min_by(F.struct(*SNAPSHOT), order).alias(name))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """fingerprint, before, after (structs or null) and changed: the names of what differs, nulls being equal.

    Both have fingerprint, severity, confidence, rule_id, path, line and snippet; of rows with one fingerprint the
    first by path, line and rule counts.  What is on one side only has all names that aren't null there.
    """
    out = _one(before, "before").join(_one(after, "after"), "fingerprint", "full")
    differs = [F.when(~F.col(f"before.{c}").eqNullSafe(F.col(f"after.{c}")), F.lit(c)) for c in SNAPSHOT]
    return out.withColumn("changed", F.filter(F.array(*differs), lambda x: x.isNotNull()))
