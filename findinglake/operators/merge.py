"""Reports of one issue merged into one finding.

A group's reports have an order: those with a traced flow first, then those of the AI engine, those of the library's own
scanners, higher confidence, higher severity, then as they came.  Lists are united in that order, each value where it
first stands; only distinct values of a group are collected, so a group with many reports stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.domain import CONFIDENCES
from findinglake.functions.columns import confidence_rank, exploitability_rank, severity_rank
from findinglake.operators.components import grouped_by_keys
from findinglake.operators.correlate import correlate

_PLAIN = ["rule_id", "title", "vuln_class", "path", "line"]


def family() -> Column:
    """The class that a report is grouped by: that of the sink it reaches, if it names one."""
    return F.coalesce(F.nullif(F.col("base_class"), F.lit("")), "vuln_class")


def report_order() -> Column:
    """A struct that sorts the best report first; ord breaks ties."""
    down = lambda c: (-c.cast("int"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.struct(
        down(yes("has_flow")).alias("flow"), down(yes("ai")).alias("ai"), down(yes("own")).alias("own"),
        down(confidence_rank(F.col("confidence"))).alias("confidence"), down(severity_rank(F.col("severity"))).alias("severity"),
        F.col("ord").alias("ord"),
    )


TEXT_LISTS = ("scanners", "cwe", "references", "tags")
EVIDENCE = "array<struct<kind:string,source:string,summary:string,line:int>>"


def united(reports: DataFrame, lists: tuple[str, ...], by: str = "group_id") -> DataFrame:
    """by and, for each list column, the distinct non-null values in the reports' order, each where it first stands.

    All lists of a report are exploded at once, distinct values are found on the map side, and only these are collected.
    A list is of texts, or `evidence` of type EVIDENCE, whose values are equal if all their fields are.
    """

    def told(c: str) -> Column:
        def value(v: Column, i: Column) -> Column:
            text, proof = (F.lit(None).cast("string"), v) if c == "evidence" else (v, F.lit(None).cast(EVIDENCE[6:-1]))
            return F.struct(F.lit(c).alias("list"), text.alias("text"), proof.alias("proof"), i.alias("at"))

        return F.transform(c, value)

    each = [told(c) for c in lists]
    values = F.concat(*(F.coalesce(x, F.array().cast(f"array<struct<list:string,text:string,proof:{EVIDENCE[6:-1]},at:int>>")) for x in each))
    rows = reports.select(by, report_order().alias("_o"), F.explode(values).alias("_v")).where("_v.text is not null or _v.proof is not null")
    first = rows.groupBy(by, "_v.list", "_v.text", "_v.proof").agg(F.min(F.struct("_o", "_v.at")).alias("_at"))
    found = F.array_sort(F.collect_list(F.struct("_at", "list", "text", "proof")))
    pick = lambda c: F.transform(F.filter("_found", lambda x: x["list"] == c), lambda x: x["proof" if c == "evidence" else "text"])
    return first.groupBy(by).agg(found.alias("_found")).select(by, *(pick(c).alias(c) for c in lists))


def merge_groups(reports: DataFrame, by: str = "group_id", lists: tuple[str, ...] = ("scanners", "cwe")) -> DataFrame:
    """One row per group: the best report's rule, title, class and place; united lists; merged confidence, severity and
    exploitability; how many reports there are, whether agreement raised the confidence, and the reason in words.

    Confidence and exploitability are the highest; severity is the highest of reports with confidence MEDIUM or more,
    or of all if none has.  Two scanners or more (by the name before a colon) raise a confidence below HIGH by one level if the
    exploitability is LIKELY or PROVEN_DATAFLOW.  lists, of TEXT_LISTS and `evidence`, has `scanners`; groups without
    any value have an empty list.  reason is null for a group of one report.
    """
    top = lambda c, r: F.max_by(c, r(F.col(c)))
    credible = confidence_rank(F.col("confidence")) >= CONFIDENCES.index("MEDIUM")
    trusted = F.max_by("severity", F.when(credible, severity_rank(F.col("severity"))))
    out = reports.groupBy(by).agg(
        F.min_by(F.struct(*_PLAIN, F.col("severity").alias("own_severity")), report_order()).alias("best"), F.count("*").alias("merged"),
        top("confidence", confidence_rank).alias("confidence"), F.coalesce(trusted, top("severity", severity_rank)).alias("severity"),
        top("exploitability", exploitability_rank).alias("exploitability"),
    )
    kind = {c: EVIDENCE if c == "evidence" else "array<string>" for c in lists}
    out = out.join(united(reports, lists, by), by, "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in kind.items()})
    names = F.size(F.array_distinct(F.transform("scanners", lambda s: F.split_part(s, F.lit(":"), F.lit(1)))))
    likely = exploitability_rank(F.col("exploitability")) >= 2
    raised = (F.col("merged") > 1) & (names >= 2) & F.col("confidence").isin("LOW", "MEDIUM") & likely
    up = F.when(F.col("confidence") == "LOW", "MEDIUM").otherwise("HIGH")
    out = out.withColumn("raised", raised).withColumn("confidence", F.when(raised, up).otherwise(F.col("confidence")))
    where = F.coalesce(F.concat_ws(":", "best.path", F.nullif("best.line", F.lit(0)).cast("string")), F.lit(""))
    reason = F.concat(
        F.col("merged").cast("string"), F.lit(" reports of "), F.coalesce("best.vuln_class", F.lit("one issue")), F.when(where != "", F.concat(F.lit(" at "), where)).otherwise(""),
        F.lit(" by "), F.array_join("scanners", ", "), F.lit("."), F.when(F.col("raised"), " The scanners agree: confidence one level up.").otherwise(""),
        F.when(F.col("severity") != F.col("best.own_severity"), F.concat(F.lit(" Severity "), "severity", F.lit(" is that of the worst report to be trusted."))).otherwise(""),
    )
    return out.select(by, *(f"best.{c}" for c in _PLAIN), "merged", "confidence", "severity", "exploitability", "raised", *lists, F.when(F.col("merged") > 1, reason).alias("reason"))


def secret_group() -> Column:
    """Reports of a secret are one issue if path and line are equal; a missing path or line equals a missing one."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce("path", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit("\x00"))), 256)


def alias_keys() -> Column:
    """The keys by which reports of a dependency meet: its package and version with its advisory and each alias."""
    ids = F.array_distinct(F.array_compact(F.concat(F.array(F.coalesce("advisory_id", "rule_id")), F.coalesce("aliases", F.array().cast("array<string>")))))
    base = F.concat_ws("|", F.col("ecosystem"), F.lower("package_name"), F.coalesce("version", F.lit("")))
    return F.transform(F.filter(ids, lambda i: i != ""), lambda i: F.concat(base, F.lit("|"), i))


def correlated(reports: DataFrame) -> DataFrame:
    """id and group_id, the smallest id of its group, of each report; ids are in the order in which reports came.

    reports: id (long), source_kind, vuln_class, base_class, path, line, scanners, rule_id, and for dependencies ecosystem,
    package_name, version, advisory_id, aliases.  Dependencies meet over their package, version and any shared advisory
    or alias; a report that bridges two groups makes them one.  Secrets (and the class hardcoded_secret) are one by path
    and line.  Other reports join within two lines of a group's first one, or on its line if the scanner (the first of
    `scanners`) is the same; those of tests, and those without path or line, stay alone.
    """
    kind, none = F.col("source_kind"), F.lit(None).cast("string")
    secret = (kind != "DEPENDENCY") & ((kind == "SECRET") | (F.coalesce("vuln_class", F.lit("")) == "hardcoded_secret"))
    code = ~secret & ~kind.isin("DEPENDENCY", "LLM_TEST") & F.col("path").isNotNull() & F.col("line").isNotNull()
    rows = reports.withColumn("branch", F.when(kind == "DEPENDENCY", "package").when(secret, "secret").when(code, "code").otherwise("alone"))
    packages = grouped_by_keys(rows.where("branch = 'package'").select("id", alias_keys().alias("keys")))
    keyed = rows.where("branch = 'secret'").select("id", secret_group().alias("key"))
    secrets = keyed.join(keyed.groupBy("key").agg(F.min("id").alias("group_id")), "key").select("id", "group_id")
    scanner = F.coalesce(F.get("scanners", F.lit(0)), none, F.lit(""))
    at = rows.where("branch = 'code'").select("id", "path", F.coalesce(family(), F.lit("")).alias("family"), F.col("line").cast("int").alias("line"), scanner.alias("scanner"))
    anchors = correlate(at.withColumnRenamed("id", "ord"))
    first = at.groupBy("path", "family", F.col("line").alias("anchor_line"), F.col("scanner").alias("anchor_scanner")).agg(F.min("id").alias("group_id"))
    groups = anchors.join(first, ["path", "family", "anchor_line", "anchor_scanner"]).select("path", "family", "line", "scanner", "group_id")
    codes = at.join(groups, ["path", "family", "line", "scanner"]).select("id", "group_id")
    alone = rows.where("branch = 'alone'").select("id", F.col("id").alias("group_id"))
    return packages.unionByName(secrets).unionByName(codes).unionByName(alone)


def correlated_findings(reports: DataFrame, lists: tuple[str, ...] = (*TEXT_LISTS, "evidence")) -> DataFrame:
    """One finding for each group of `correlated`: what merge_groups tells, with the group's first id.

    reports also has ord (equal to id), title, has_flow, ai, own, severity, confidence, exploitability and the lists.
    """
    return merge_groups(reports.join(correlated(reports), "id"), "group_id", lists)
