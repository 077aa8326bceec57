"""What scans yield and how they compare, for any number of scans in one job: united outputs of scanners, statistics,
results of retests, and slugs that stay unique.

Every table carries scan_id.  Null statuses, severities and kinds aren't counted; scans without rows give zeros and empty
maps, empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.functions.columns import slugify
from findinglake.operators.numbering import numbered
from findinglake.operators.retest import fuzzy_matches
from findinglake.operators.secrets import redact

ADVISORIES = "dependency-advisories"  # fixed value: the scanner that must have run for a dependency's finding to be gone


def united_outputs(outputs: dict[str, DataFrame], runs: DataFrame) -> DataFrame:
    """The findings of all scanners, in the order in which `outputs` names them and then by ord, numbered in each scan.

    outputs: name -> scan_id, ord (whole numbers), path, snippet and more (columns that some lack are null); runs:
    scan_id, scanner, status.  Only runs that succeeded count, so a scanner that failed halfway through hides nothing of
    the others and leaves nothing behind.  Snippets are masked.
    """
    names = list(outputs)
    each = [df.withColumns({"scanner": F.lit(n), "_place": F.lit(i)}) for i, (n, df) in enumerate(outputs.items())]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    ran = runs.where((F.col("status") == "ran") & F.col("scanner").isin(names)).select("scan_id", "scanner")
    rows = rows.join(ran, ["scan_id", "scanner"], "left_semi")
    rows = rows.withColumn("snippet", redact(F.col("snippet"), F.col("path")))
    return numbered(rows, "scan_id", {"place": F.col("_place")}, "ord", "number").drop("_place")


def run_errors(runs: DataFrame, most: int = 200) -> DataFrame:
    """scan_id, scanner and text of each run that failed; details are cut to `most` characters, as runs' messages are."""
    detail = F.substring(F.coalesce("detail", F.lit("")), 1, most)
    text = F.concat(F.col("scanner"), F.lit(" failed"), F.when(detail != "", F.concat(F.lit(": "), detail)).otherwise(F.lit("")))
    return runs.where("status = 'failed'").select("scan_id", "scanner", text.alias("text"))


def files_after(files: DataFrame, problems: DataFrame) -> DataFrame:
    """files (scan_id, path, status, detail) with what scanners say of them (scan_id, path, ord, detail; the last counts).

    A detail that tells of a failure, or that analysis was prevented, makes the file's status PARSE_ERROR.
    """
    told = problems.groupBy("scan_id", "path").agg(F.max_by("detail", F.struct("ord", "detail")).alias("_told"))
    rows = files.join(told, ["scan_id", "path"], "left")
    broken = F.coalesce(F.col("_told").contains("prevented") | F.col("_told").contains("failure"), F.lit(False))
    rows = rows.withColumns({"status": F.when(broken, "PARSE_ERROR").otherwise(F.col("status")), "detail": F.coalesce("_told", "detail")})
    return rows.drop("_told")


def _counts(rows: DataFrame, column: str, name: str) -> DataFrame:
    """scan_id, name_total and name_by_column (a map, null left out): grouped by value first, so maps are made of few rows."""
    n = rows.groupBy("scan_id", column).agg(F.count("*").alias("n"))
    entry = F.when(F.col(column).isNotNull(), F.struct(column, "n"))
    return n.groupBy("scan_id").agg(F.sum("n").alias(f"{name}_total"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(f"{name}_by_{column}"))


def scan_statistics(scans: DataFrame, files: DataFrame, findings: DataFrame, dependencies: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """One row for each scan: totals of files, findings and dependencies, their counts by status, severity, source_kind
    and vuln_status, and the languages of analysed files with files, lines (null: 0) and whether static analysis knows them.

    files: scan_id, status, language, lines; findings: scan_id, severity, source_kind; dependencies: scan_id,
    vuln_status.  Lines are those of analysed files with a language.
    """
    done = files.where("status = 'ANALYZED' and language is not null").groupBy("scan_id", "language").agg(
        F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines")
    )
    known = F.struct("files", "lines", F.col("language").isin(list(supported)).alias("sast"))
    languages = done.groupBy("scan_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", known)))).alias("languages"), F.sum("lines").alias("lines_analyzed")
    )
    parts = [
        _counts(files, "status", "files"), languages, _counts(findings, "severity", "findings"),
        _counts(findings, "source_kind", "findings").drop("findings_total"), _counts(dependencies, "vuln_status", "dependencies"),
    ]
    rows = reduce(lambda a, b: a.join(b, "scan_id", "left"), parts, scans.select("scan_id").distinct())
    none = F.create_map().cast("map<string,bigint>")
    totals = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("files_total", "lines_analyzed", "findings_total", "dependencies_total")}
    maps = {c: F.coalesce(c, none) for c in rows.columns if "_by_" in c}
    empty = F.create_map().cast(rows.schema["languages"].dataType)
    rows = rows.withColumns(totals | maps | {"languages": F.coalesce("languages", empty)})
    return rows.withColumn("files_analyzed", F.coalesce(F.element_at("files_by_status", F.lit("ANALYZED")), F.lit(0).cast("long")))


def _in_scan(rows: DataFrame) -> DataFrame:
    """Rows as the fuzzy comparison takes them: a path is one of its own scan, and rows are told apart by ord."""
    path = F.concat_ws("\x00", F.col("scan_id").cast("string"), F.col("path"))
    return rows.withColumns({"path": F.when(F.col("path").isNotNull(), path), "id": F.col("ord").cast("string")})


def retests(baseline: DataFrame, current: DataFrame, scans: DataFrame, files: DataFrame, runs: DataFrame, history: DataFrame) -> DataFrame:
    """scan_id, base_ord, cur_ord, fingerprint, result, match and note of each finding of a scan or of its baseline.

    baseline, current: scan_id (of the new scan), ord (whole numbers that tell all rows of a table apart), fingerprint,
    rule_id, vuln_class, source_kind, path, line, function, snippet, scanners (array).  scans: scan_id, partial.  files:
    scan_id, path, status.  runs: scan_id, scanner, status.  history: scan_id, fingerprint resolved before.

    The first baseline row of a fingerprint is answered by the current one (of equal fingerprints the last row counts, at
    the first one's place); the other rows, and those without a counterpart, may match changed code.  What is left is,
    in this order: of a file that wasn't analysed NOT_TESTED (partial scans) or NOT_REPRODUCED; of a scanner that
    didn't run NOT_TESTED; else RESOLVED.  A dependency's scanner is the look-up of advisories; others' names end at
    the first colon.  A row without scanners has none that ran.
    """
    key = ["scan_id", "fingerprint"]
    body = F.struct(*(c for c in current.columns if c not in (*key, "ord")))
    now = current.groupBy(*key).agg(F.min("ord").alias("ord"), F.max_by(body, "ord").alias("x")).select(*key, "ord", "x.*")
    first = baseline.groupBy(*key).agg(F.min("ord").alias("ord"))
    matched = first.join(now.select(*key, F.col("ord").alias("cur_ord")), key)
    pending = baseline.join(matched.select("ord"), "ord", "left_anti")
    fresh = now.join(first, key, "left_anti")
    found = fuzzy_matches(_in_scan(pending), _in_scan(fresh)).select(F.col("base").cast("long").alias("ord"), F.col("cur").cast("long").alias("cur_ord"))

    looked = files.where("status = 'ANALYZED'").select("scan_id", "path").distinct().withColumn("analysed", F.lit(True))
    ran = runs.where("status = 'ran'").groupBy("scan_id").agg(F.collect_set("scanner").alias("ran"))  # a scan's few scanners
    left = pending.join(found, "ord", "left").join(looked, ["scan_id", "path"], "left").join(ran, "scan_id", "left")
    left = left.join(scans.groupBy("scan_id").agg(F.max("partial").alias("partial")), "scan_id", "left")
    names = F.transform(F.coalesce("scanners", F.array().cast("array<string>")), lambda s: F.split_part(s, F.lit(":"), F.lit(1)))
    needed = F.when(F.col("source_kind") == "DEPENDENCY", F.array(F.lit(ADVISORIES))).otherwise(names)
    tested = F.coalesce(F.arrays_overlap(needed, "ran"), F.lit(False))
    away = F.col("path").isNotNull() & F.col("analysed").isNull()
    partial = F.coalesce("partial", F.lit(False))
    same = F.col("cur_ord").isNotNull()
    result = F.when(same, "STILL_OPEN").when(away & partial, "NOT_TESTED").when(away, "NOT_REPRODUCED").when(~tested, "NOT_TESTED").otherwise("RESOLVED")
    note = (
        F.when(same, "Found again in code that has changed since.")
        .when(away & partial, F.concat("path", F.lit(" is outside of what this scan looked at.")))
        .when(away, F.concat("path", F.lit(" wasn't analysed this time, which proves no fix.")))
        .when(~tested, F.concat(F.lit("None of its scanners ran: "), F.array_join(needed, ", "), F.lit(".")))
        .otherwise("Its file was analysed by its scanner, which doesn't report it any more.")
    )

    def items(rows: DataFrame, base, cur, result, match, note) -> DataFrame:
        cells = {"base_ord": base, "cur_ord": cur, "fingerprint": F.col("fingerprint"), "result": result, "match": match, "note": note}
        return rows.select("scan_id", *(c.alias(n) for n, c in cells.items()))

    no, lit = F.lit(None).cast("long"), F.lit
    again = items(matched, F.col("ord"), F.col("cur_ord"), lit("STILL_OPEN"), lit("FINGERPRINT"), lit("Found again in the same code."))
    rest = items(left, F.col("ord"), F.col("cur_ord"), result, F.when(same, "FUZZY").otherwise("NONE"), note)
    fresh = fresh.join(found.select(F.col("cur_ord").alias("ord")), "ord", "left_anti")
    fresh = fresh.join(history.select(*key).distinct().withColumn("was", lit(True)), key, "left")
    back = F.coalesce("was", lit(False))
    new = items(
        fresh, no, F.col("ord"), F.when(back, "REGRESSION").otherwise("NEW"), F.when(back, "FINGERPRINT").otherwise("NONE"),
        F.when(back, "It was resolved before and is here again.").otherwise("The baseline doesn't have it."),
    )
    return again.unionByName(rest).unionByName(new)


def base_slug(name: Column, most: int = 100) -> Column:
    return F.coalesce(F.nullif(slugify(name, most), F.lit("")), F.lit("item"))


def unique_slugs(existing: DataFrame, incoming: DataFrame, by: str = "organization_id") -> DataFrame:
    """incoming with a `slug` that no other row of its group of `by` has, neither existing nor new.

    existing: by, slug.  incoming: by, name, ord (whole numbers that tell all rows apart).  If a name's slug is free, the
    first row with it takes it; the others get its smallest free numbers from 2 on, in the order of ord.  Slugs that are
    some new name's own are left to it, so that all names can be settled at once; two numbered slugs can't meet, as
    what stands before the last dash differs.  No name's rows pass one task whole.
    """
    rows = incoming.withColumn("_base", base_slug(F.col("name")))
    keyed = lambda df, base: df.withColumn("_key", F.to_json(F.struct(F.col(by), base.alias("b")), {"ignoreNullFields": "false"}))
    rows = keyed(rows, F.col("_base"))
    there = keyed(existing.select(by, F.col("slug").alias("_base")).distinct(), F.col("_base")).select("_key", "_base", by)
    first = rows.groupBy("_key").agg(F.min("ord").alias("ord"), F.first("_base").alias("_base"), F.first(by).alias(by))
    own = first.join(there.select("_key"), "_key", "left_anti")
    rest = rows.join(own.select("_key", "ord"), ["_key", "ord"], "left_anti")
    # Numbers of a base that are taken: those of existing slugs and of names that end in a number themselves.
    parts = there.select(by, "_base").unionByName(own.select(by, "_base"))
    cut = [F.regexp_extract("_base", "^(.*)-([1-9][0-9]{0,17})$", i) for i in (1, 2)]
    taken = parts.select(by, cut[0].alias("_before"), F.try_to_number(F.nullif(cut[1], F.lit("")), F.lit("9" * 18)).cast("long").alias("t"))
    taken = keyed(taken.where("t >= 2"), F.col("_before")).select("_key", "t").distinct().join(rest.select("_key").distinct(), "_key", "left_semi")
    taken = numbered(taken, "_key", {}, "t", "i").select("_key", (F.col("t") - 1 - F.col("i")).alias("free"))  # free numbers before it
    rest = numbered(rest, "_key", {}, "ord", "_k")
    line = rest.select("_key", "ord", (F.col("_k") * 2).alias("u")).unionByName(taken.select("_key", F.lit(None).cast("long").alias("ord"), (F.col("free") * 2 + 1).alias("u")))
    place = numbered(line, "_key", {}, "u", "_n").where("ord is not null").select("ord", "_n")
    number = F.concat("_base", F.lit("-"), (F.col("_n") + 1).cast("string"))
    named = rest.join(place, "ord").select(*incoming.columns, number.alias("slug"))
    return rows.join(own.select("_key", "ord"), ["_key", "ord"], "left_semi").select(*incoming.columns, F.col("_base").alias("slug")).unionByName(named)
