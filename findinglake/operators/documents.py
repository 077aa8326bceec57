"""Reports as whole documents: JSON, HTML and Markdown, each written by all executors and joined in the commit.

What a report says besides its lists (summary, scope, methods, limits) is aggregated into one row that doesn't grow with
the findings; findings and dependencies are rows of the document.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findinglake.domain import SEVERITIES
from findinglake.functions.columns import markdown_code, markdown_escape
from findinglake.operators import reports
from findinglake.operators.sarif import with_defaults
from findinglake.sinks.document import section, write_document

_TEXTS = "array<string>"
FINDING = {
    "public_id": "string", "rule_id": "string", "engine": "string", "source_kind": "string", "category": "string", "vuln_class": "string", "title": "string", "severity": "string",
    "confidence": "string", "exploitability": "string", "verification": "string", "cwe": _TEXTS, "owasp": _TEXTS, "path": "string", "line": "int", "end_line": "int", "col": "int",
    "function": "string", "snippet": "string", "description": "string", "impact": "string", "recommendation": "string", "remediation": "string", "references": _TEXTS,
    "scanners": _TEXTS, "fingerprint": "string",
    "evidence": "array<struct<kind:string,source:string,summary:string,data:map<string,string>,steps:array<struct<path:string,line:int,note:string>>>>",
}
DEPENDENCY = {
    "ecosystem": "string", "name": "string", "version": "string", "version_spec": "string", "manifest_path": "string", "direct": "boolean", "dev": "boolean", "vuln_status": "string",
    "advisory_ids": _TEXTS, "source": "string",
}


def _tally(rows: DataFrame, column: str, fixed: list[str] | None = None) -> DataFrame:
    """One row, map: how many rows have each value (null left out), or each of the fixed values, in their order."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"))
    every = F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n"))))
    if fixed:
        zero = lambda v: F.coalesce(F.element_at("m", F.lit(v)), F.lit(0).cast("long"))
        return counts.agg(every.alias("m")).select(F.create_map(*(x for v in fixed for x in (F.lit(v), zero(v)))).alias("m"))
    return counts.agg(every.alias("m"))


def summary(findings: DataFrame, dependencies: DataFrame) -> DataFrame:
    """One row: total, by_severity (all of them, worst first), by_source, by_verification, by_exploitability, dependencies.

    Findings are counted by all four at once, and the rest works on these few rows.
    """
    kinds = ["severity", "source_kind", "verification", "exploitability"]
    counts = findings.groupBy(*kinds).agg(F.count("*").alias("n"))
    by = {"by_severity": ("severity", SEVERITIES[::-1]), "by_source": ("source_kind", None), "by_verification": ("verification", None), "by_exploitability": ("exploitability", None)}
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.lit(1).alias("one"))
    for name, (column, fixed) in by.items():
        out = out.join(_tally(counts, column, fixed).select(F.col("m").alias(name), F.lit(1).alias("one")), "one")
    states = dependencies.groupBy("vuln_status").agg(F.count("*").alias("n"))
    return out.join(_tally(states, "vuln_status").select(F.col("m").alias("dependencies"), F.lit(1).alias("one")), "one").drop("one")


def context(
    findings: DataFrame, dependencies: DataFrame, files: DataFrame, scanners: DataFrame, *, target: str, partial: bool = False, supported: tuple[str, ...] = (),
    errors: list[str] = (), told: dict | None = None,
) -> dict:
    """A report's sections but its lists: meta, summary, gate, risk, retest, scope, methodology, limitations, errors (50).

    told: title, project, tool, tool_version, generated_at, started_at, finished_at, commit, branch, gate, risk, retest.
    The sections come to the driver as one row; languages and scanners are all that it has a list of.
    """
    told = told or {}
    lists = lambda df, *c: df.agg(F.array_sort(F.collect_list(F.struct("ord", *c))).alias("x")).select(F.transform("x", lambda r: F.struct(*(r[k].alias(k) for k in c))).alias("x"))
    wide = scanners.withColumn("label", reports.named(F.col("scanner")))
    runs = lists(with_defaults(wide, {"detail": "string", "findings": "long", "duration_ms": "long"}), "scanner", "label", "status", "detail", "findings", "duration_ms")
    parts = {
        "summary": summary(findings, dependencies).select(F.struct("*").alias("x")), "scope": reports.scope(files, scanners).select(F.struct("*").alias("x")), "scanners": runs,
        "methodology": lists(reports.methodology(scanners), "name", "text"), "limitations": lists(reports.limitations(files, scanners, dependencies, findings, partial, supported, len(errors)), "text"),
    }
    row = None
    for name, part in parts.items():
        one = part.select(F.col("x").alias(name), F.lit(1).alias("one"))
        row = one if row is None else row.join(one, "one")
    found = json.loads(row.select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("x")).first()[0])
    scope = found["scope"] | {k: told.get(k) for k in ("commit", "branch", "started_at", "finished_at")} | {"target": target, "scope": "PARTIAL" if partial else "FULL"}
    scope["languages"] = [{"name": x["language"], "files": x["files"], "lines": x["lines"], "sast": x["language"] in supported} for x in scope["languages"]]
    scope |= {"scanners": found["scanners"], "dependencies_total": sum(found["summary"]["dependencies"].values())}
    return {
        "meta": {"title": told.get("title") or f"Security scan report: {target}", "project": told.get("project"), "tool": told.get("tool", "findinglake"), "tool_version": told.get("tool_version", "1"),
                 "generated_at": told.get("generated_at")},
        "summary": found["summary"], "gate": told.get("gate"), "risk": told.get("risk"), "retest": told.get("retest"), "scope": scope, "methodology": found["methodology"],
        "limitations": [x["text"] for x in found["limitations"]], "errors": list(errors)[:50],
    }


def finding_records(findings: DataFrame) -> DataFrame:
    """findings as a report has them: all columns of FINDING (missing ones null), with location and steps."""
    known = with_defaults(findings, FINDING)
    lists = {c: F.coalesce(c, F.array().cast(t)) for c, t in FINDING.items() if t.startswith("array")}
    return reports.explained(reports.finding_views(known.withColumns(lists)))


def _record(rows: DataFrame) -> Column:
    """A finding's JSON; evidence without its data, which the steps tell."""
    place = F.struct("path", F.col("line").alias("start_line"), "end_line", F.col("col").alias("start_col"), "function", "snippet")
    proof = F.transform("evidence", lambda e: F.struct(e["kind"].alias("kind"), e["source"].alias("source"), e["summary"].alias("summary")))
    skip = {"path", "line", "end_line", "col", "function", "snippet", "evidence"}
    whole = F.struct(*(F.col(c) for c in FINDING if c not in skip), F.when(F.col("path").isNotNull(), place).alias("location"), proof.alias("evidence"), "steps")
    return F.to_json(whole)


def write_json(findings: DataFrame, dependencies: DataFrame, path: str, about: dict) -> str:
    """Writes one JSON report: the scan's result with findings by ord and dependencies by name, a line each, and the
    report's sections; `reports.read_saved` reads it.  findings has ord; about is the report's `context`."""
    scope, meta = about["scope"], about["meta"]
    head = {"schema_version": "1.0", "tool": {"name": meta["tool"], "version": meta["tool_version"]}, "target": scope["target"], "started_at": scope["started_at"],
            "finished_at": scope["finished_at"], "scanners": scope["scanners"], "errors": about["errors"], "gate": about["gate"], "risk": about["risk"], "retest": about["retest"]}
    tail = {"generated_at": meta["generated_at"], "scope": scope, "methodology": about["methodology"], "limitations": about["limitations"], "summary": about["summary"]}
    rows = finding_records(findings)
    rows = rows.select(F.lit(0).alias("section"), _record(rows).alias("text"), F.col("ord").cast("long").alias("ord"), F.lit("").alias("name"))
    deps = with_defaults(dependencies, DEPENDENCY)
    deps = deps.select(F.lit(1).alias("section"), F.to_json(F.struct(*DEPENDENCY)).alias("text"), F.lit(0).cast("long").alias("ord"), F.concat_ws("|", "manifest_path", "ecosystem", "name", "version").alias("name"))
    layout = [section(json.dumps(head)[:-1] + ', "findings": [\n', close="\n]"), section(', "dependencies": [\n', close=f'\n], "report": {json.dumps(tail)}}}\n')]
    return write_document(rows.unionByName(deps), path, layout, ["ord", "name", "text"])


def html_escape(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _plain_html(value) -> str:
    import html

    return html.escape("—" if value is None else str(value))


def write_html(findings: DataFrame, dependencies: DataFrame, path: str, about: dict) -> str:
    """Writes one HTML report without scripts: sections, each finding as an article by ord, dependencies as table rows.

    Every text of a finding is escaped, and references are links only by http and https.
    """
    x = _plain_html
    counts = "".join(f"<tr><th>{x(k)}</th><td>{x(v)}</td></tr>" for k, v in about["summary"]["by_severity"].items())
    gate, risk, scope = about["gate"] or {}, about["risk"] or {}, about["scope"]
    head = (
        f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{x(about["meta"]["title"])}</title></head><body>\n<h1>{x(about["meta"]["title"])}</h1>\n'
        f"<p>Gate: {x(gate.get('status'))}. Risk index: {x(risk.get('index'))}.</p>\n<section id=\"summary\"><h2>Summary</h2><p>{x(about['summary']['total'])} findings</p><table>{counts}</table></section>\n"
        f"<section id=\"scope\"><h2>Scope</h2><p>{x(scope['files_analyzed'])} of {x(scope['files_total'])} files, {x(scope['lines_analyzed'])} lines</p></section>\n"
        + "".join(f"<section><h3>{x(m['name'])}</h3><p>{x(m['text'])}</p></section>\n" for m in about["methodology"])
        + "<section id=\"limitations\"><h2>Limitations</h2><ul>" + "".join(f"<li>{x(t)}</li>" for t in about["limitations"]) + '</ul></section>\n<section id="findings"><h2>Findings</h2>\n'
    )
    e = lambda name: html_escape(F.col(name))
    part = lambda tag, c: F.when(c != "", F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))).otherwise("")
    steps = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("<li>"), html_escape(s["title"]), F.lit(": "), html_escape(s["detail"]), F.lit("</li>"))), "")
    links = F.array_join(F.transform("references", lambda r: F.concat(F.lit('<a rel="noreferrer" href="'), html_escape(r), F.lit('">'), html_escape(r), F.lit("</a> "))), "")
    article = F.concat(
        F.lit('<article class="'), F.lower(e("severity")), F.lit('"><h3>'), e("title"), F.lit("</h3><p>"), e("severity"), F.lit(", "), e("confidence"), F.lit(", "), e("exploitability"),
        F.lit(", "), e("verification"), F.lit("</p>"), part("code", e("location")), part("pre", e("snippet")), part("p", e("description")), part("p", e("impact")),
        part("p", e("recommendation")), F.lit("<ol>"), steps, F.lit("</ol>"), part("p", links), F.lit("</article>"),
    )
    rows = finding_records(findings).select(F.lit(0).alias("section"), article.alias("text"), F.col("ord").cast("long").alias("ord"))
    deps = with_defaults(dependencies, DEPENDENCY)
    cells = [F.concat(F.lit("<td>"), html_escape(F.col(c)), F.lit("</td>")) for c in ("ecosystem", "name", "version", "manifest_path", "vuln_status")]
    deps = deps.select(F.lit(1).alias("section"), F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("text"), F.lit(0).cast("long").alias("ord"))
    layout = [section(head, "\n", "\n</section>\n"), section('<section id="dependencies"><h2>Dependencies</h2><table>\n', "\n", "\n</table></section>\n</body></html>\n")]
    return write_document(rows.unionByName(deps), path, layout, ["ord", "text"])


def write_markdown(findings: DataFrame, path: str, about: dict, most: int = 25) -> str:
    """Writes one Markdown report: the gate, counts, and a table of the first `most` findings (the format's own limit)."""
    total, gate, risk = about["summary"]["total"], about["gate"] or {}, about["risk"] or {}
    counts = ", ".join(f"{v} {k.lower()}" for k, v in about["summary"]["by_severity"].items())
    head = f"# {about['meta']['title']}\n\nGate: **{gate.get('status', 'none')}**, risk index {risk.get('index', 'none')}\n\n{total} findings: {counts}\n\n| Severity | Finding | Location | Confidence |\n|---|---|---|---|\n"
    left = f"\n\n{total - most} more findings are in the full report.\n" if total > most else "\n"
    rows = reports.finding_views(with_defaults(findings, {"references": _TEXTS}))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", markdown_escape(F.col("severity")), markdown_escape(F.col("title")), markdown_code(F.col("location"), True), markdown_escape(F.col("confidence"))), F.lit(" |"))
    first = rows.orderBy("ord", row).limit(most).select(F.lit(0).alias("section"), row.alias("text"), F.col("ord").cast("long").alias("ord"))
    limits = "\n## Limitations\n\n" + "".join(f"- {t}\n" for t in about["limitations"])
    return write_document(first, path, [section(head, "\n", left + limits)], ["ord", "text"])
