"""Findings as a SARIF 2.1 log: rules and results as JSON rows, and the log as one document, written by all executors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.functions.columns import lookup, markdown_escape, severity_rank
from findinglake.operators.numbering import numbered
from findinglake.sinks.document import section, write_document

# SARIF levels, security-severity numbers and precisions, and ranks of problems by level.
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note", "INFO": "note"}
SECURITY_SEVERITY = {"CRITICAL": "9.5", "HIGH": "8.0", "MEDIUM": "5.5", "LOW": "3.0", "INFO": "0.0"}
PRECISIONS = {"CONFIRMED": "very-high", "HIGH": "high", "MEDIUM": "medium", "LOW": "low"}
PROBLEMS = {"error": "error", "warning": "warning", "note": "recommendation"}
SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
_TEXTS = "array<string>"


def level(severity: Column) -> Column:
    return lookup(severity, LEVELS, "none")


def with_defaults(findings: DataFrame, columns: dict[str, str]) -> DataFrame:
    """findings with the columns of a name -> type mapping that they lack, as nulls."""
    return findings.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in findings.columns})


_RULE = {
    "confidence": "string", "class_name": "string", "class_description": "string", "class_recommendation": "string", "description": "string", "recommendation": "string",
    "owasp": _TEXTS, "references": _TEXTS, "cwe": _TEXTS, "category": "string",
}


def rules(findings: DataFrame) -> DataFrame:
    """rule_id, rule_index (from 0, by first ord, then id) and rule, the JSON, of each distinct rule.

    findings: ord (a whole number), rule_id, vuln_class, severity, title and cwe, and those of confidence, class_name,
    class_description, class_recommendation, description, recommendation, owasp, references and category that there are.
    A rule is described by its first finding; level and security-severity are those of its worst.  Findings are reduced
    to one row for each rule first, and rules are numbered in blocks, so no task sees all of either.
    """
    told = with_defaults(findings, _RULE)
    fields = ["vuln_class", "title", *_RULE]
    first = told.groupBy("rule_id").agg(
        F.min("ord").alias("at"), F.min_by(F.struct(*fields), F.struct("ord", "title")).alias("f"), F.max_by("severity", severity_rank(F.col("severity"))).alias("worst")
    )
    named = F.array_join(F.transform(F.filter(F.split(F.lower("f.vuln_class"), r"[_\-\s]+"), lambda x: x != ""), F.initcap), "")
    name = F.coalesce("f.class_name", "f.category", "f.title")
    advice = F.coalesce(F.nullif("f.recommendation", F.lit("")), "f.class_recommendation", F.lit(""))
    described = F.substring(F.coalesce("f.class_description", "f.description", F.lit("")), 1, 1000)
    no = F.array().cast(_TEXTS)
    link = F.get(F.coalesce("f.references", no), F.lit(0))
    tags = F.concat(F.array(F.lit("security")), F.coalesce("f.cwe", no), F.transform(F.coalesce("f.owasp", no), lambda o: F.split_part(o, F.lit(" "), F.lit(1))))
    at_level = level(F.col("worst"))
    rule = F.struct(
        F.col("rule_id").alias("id"), named.alias("name"), F.struct(name.alias("text")).alias("shortDescription"),
        F.struct(F.coalesce(F.nullif(described, F.lit("")), name).alias("text")).alias("fullDescription"),
        F.struct(F.coalesce(F.nullif(advice, F.lit("")), name).alias("text"), F.concat(F.lit("**"), name, F.lit("**\n\n"), advice).alias("markdown")).alias("help"),
        F.when(link.startswith("https://"), link).alias("helpUri"), F.struct(at_level.alias("level")).alias("defaultConfiguration"),
        F.struct(
            tags.alias("tags"), lookup(F.col("worst"), SECURITY_SEVERITY, None).alias("security-severity"), lookup(F.col("f.confidence"), PRECISIONS, None).alias("precision"),
            lookup(at_level, PROBLEMS, None).alias("problem.severity"),
        ).alias("properties"),
    )
    rows = numbered(first.select("rule_id", "at", F.to_json(rule).alias("rule"), F.lit(0).alias("all")), "all", {}, "at", "place", ties=("rule_id",))
    return rows.select("rule_id", (F.col("place") - 1).cast("int").alias("rule_index"), "rule")


def _uri(path: Column) -> Column:
    """A path as a relative URI: no leading slash, what isn't unreserved or a slash as %XX."""
    plain = F.ltrim(F.translate(path, "\\", "/"), F.lit("/"))
    out = F.url_encode(plain)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _place(path: Column, start: Column, end: Column | None = None, col: Column | None = None, snippet: Column | None = None) -> Column:
    region = [start.alias("startLine")]
    if end is not None:
        region += [F.when(end >= start, end).alias("endLine"), F.when(col > 0, col).alias("startColumn")]
    if snippet is not None:
        region.append(F.when(snippet != "", F.struct(snippet.alias("text"))).alias("snippet"))
    where = F.struct(_uri(path).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
    return F.struct(where.alias("artifactLocation"), F.when(start > 0, F.struct(*region)).alias("region"))


_RESULT = {
    "end_line": "int", "col": "int", "snippet": "string", "summary": "string", "public_id": "string", "confidence": "string", "exploitability": "string", "verification": "string",
    "vuln_class": "string", "cwe": _TEXTS, "owasp": _TEXTS, "scanners": _TEXTS, "source": "struct<path:string,line:int,code:string,label:string>",
    "steps": "array<struct<path:string,line:int,note:string>>", "fingerprint": "string",
}


def results(findings: DataFrame) -> DataFrame:
    """ord and result, the JSON, of each finding: ord, rule_id, severity, title, path, line and those of end_line, col,
    snippet, summary (of the evidence), public_id, fingerprint, confidence, exploitability, verification, vuln_class,
    cwe, owasp, scanners, source and steps that there are.

    source: where data comes from (path, line, code, label); steps: array of (path, line, note) in the order of its flow.
    A flow needs two places with path and line; a result without path has no location.
    """
    told = with_defaults(findings, _RESULT)
    of = lambda p, n, code, text: F.struct(F.struct(_place(p, n, snippet=code).alias("physicalLocation"), F.struct(text.alias("text")).alias("message")).alias("location"))
    none = F.lit(None).cast("string")
    steps = F.filter("steps", lambda s: (s["path"] != "") & (s["line"] > 0))
    onward = F.transform(steps, lambda s: of(s["path"], s["line"], none, F.coalesce(F.nullif(s["note"], F.lit("")), F.lit("data flows here"))))
    begin = of(F.col("source.path"), F.col("source.line"), F.col("source.code"), F.concat(F.lit("Source: "), F.coalesce("source.label", F.lit("untrusted input"))))
    known = (F.col("source.path") != "") & (F.col("source.line") > 0)
    flow = F.concat(F.when(known, F.array(begin)).otherwise(F.array().cast(onward_type(told, onward))), F.coalesce(onward, F.array().cast(onward_type(told, onward))))
    more = F.col("summary").isNotNull() & (F.col("summary") != "") & (F.col("summary") != F.col("title"))
    message = F.substring(F.when(more, F.concat("title", F.lit(". "), "summary")).otherwise(F.col("title")), 1, 2000)
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level(F.col("severity")).alias("level"), F.struct(message.alias("text")).alias("message"),
        F.struct(F.col("fingerprint").alias("findinglake/v1")).alias("partialFingerprints"),
        F.struct(
            F.col("public_id").alias("findingId"), "severity", "confidence", "exploitability", "verification", F.col("vuln_class").alias("vulnerabilityClass"), "cwe", "owasp", "scanners"
        ).alias("properties"),
        F.when(F.col("path") != "", F.array(F.struct(_place(F.col("path"), F.col("line"), F.col("end_line"), F.col("col"), F.col("snippet")).alias("physicalLocation")))).alias("locations"),
        F.when(F.size("flow") >= 2, F.array(F.struct(F.array(F.struct(F.col("flow").alias("locations"))).alias("threadFlows")))).alias("codeFlows"),
    )
    # The join with the rules' numbers is left to AQE, which knows their size.
    index = rules(findings).select("rule_id", "rule_index")
    return told.withColumn("flow", flow).join(index, "rule_id").select("ord", F.to_json(result).alias("result"))


def onward_type(rows: DataFrame, column: Column) -> str:
    """The type of an expression over rows."""
    return rows.select(column.alias("x")).schema["x"].dataType.simpleString()


def write_sarif(
    findings: DataFrame, path: str, target: str, tool: dict | None = None, started_at: str | None = None, finished_at: str | None = None,
    gate: dict | None = None, risk_index: float | None = None, errors: list[str] = (), skipped: list[str] = (),
) -> str:
    """Writes one SARIF log: rules in their order, then results by ord, a line each; the path.

    tool: name, version, uri.  errors (the first 100) and skipped, the scanners that didn't run, are notifications, cut to
    1000 characters.  The rest of the log is these few texts, so nothing that grows with the findings is in one task.
    """
    tool = {"name": "findinglake", "version": "1", "uri": "https://example.org/findinglake"} | (tool or {})
    notes = [{"level": "warning", "message": {"text": e[:1000]}} for e in list(errors)[:100]] + [{"level": "note", "message": {"text": s[:1000]}} for s in skipped]
    call = {"executionSuccessful": True, "startTimeUtc": started_at, "endTimeUtc": finished_at, "toolExecutionNotifications": notes}
    call = {k: v for k, v in call.items() if v is not None}
    driver = {"name": tool["name"], "version": tool["version"], "semanticVersion": tool["version"], "informationUri": tool["uri"]}
    head = f'{{"$schema": {json.dumps(SCHEMA)}, "version": "2.1.0", "runs": [{{"tool": {{"driver": {json.dumps(driver)[:-1]}, "rules": [\n'
    between = (
        f'\n]}}}}, "automationDetails": {json.dumps({"id": f"findinglake/{target}/"})}, "invocations": {json.dumps([call])}, '
        '"originalUriBaseIds": {"%SRCROOT%": {"description": {"text": "Root of the scanned source tree"}}}, "results": [\n'
    )
    tail = f'\n], "properties": {json.dumps({"gate": gate, "riskIndex": risk_index})}}}]}}\n'
    rows = rules(findings).select(F.lit(0).alias("section"), F.col("rule").alias("text"), F.col("rule_index").cast("long").alias("ord"))
    rows = rows.unionByName(results(findings).select(F.lit(1).alias("section"), F.col("result").alias("text"), F.col("ord").cast("long").alias("ord")))
    return write_document(rows, path, [section(head), section(between, close=tail)], ["ord", "text"])


def markdown_rows(findings: DataFrame, most: int = 25) -> DataFrame:
    """ord and row: a Markdown table's rows of the first findings (the limit is the report's own)."""
    cell = markdown_escape
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in ("severity", "title", "path", "line"))), F.lit(" |"))
    return findings.orderBy("ord").limit(most).select("ord", row.alias("row"))
