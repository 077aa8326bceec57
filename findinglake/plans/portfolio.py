"""Registered queries on dashboards, access, identities, merged reports, states and adapters, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.operators import access, dashboard, findings as O, identity, lifecycle, merge, reports, secrets
from findinglake.plans import adapter as A
from findinglake.plans.catalog import _F, _O, _S, _fingerprint
from findinglake.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
_KEY = b"finding lake test key"


def _scored(spark, sf):
    return A.findings(spark, sf).withColumn("risk_score", F.round(O.finding_risk(), 3))


def _top(spark, sf):
    return dashboard.top_by_risk(_scored(spark, sf)).select("finding_id", "project_id", "severity", "risk_score")


def _scans(spark, sf):
    users = A.table(spark, sf, "events").select(F.col("event_id").alias("scan_id"), F.col("user_id").alias("repository_id"))
    return A.scans(spark, sf).join(users, "scan_id")


def _recent(spark, sf):
    return dashboard.recent_scans(_scans(spark, sf), A.repositories(spark, sf)).select("scan_id", "status", "finished_at", "repository_name")


def _scan_list(spark, sf):
    rows = O.filtered(A.scans(spark, sf), project_id=3, status="COMPLETED")
    out = dashboard.page_with_total(rows, [F.desc("finished_at"), F.desc("scan_id")], 2, 10)
    return out.select("scan_id", "finished_at", "total")


def _latest(spark, sf):
    return O.latest(A.scans(spark, sf), "project_id", "finished_at", "scan_id", "status")


def _projects(spark, sf):
    return dashboard.projects_with_latest(A.projects(spark, sf), A.scans(spark, sf), A.findings(spark, sf))


def _summary(spark, sf):
    sections = {
        "open_by_severity": ("severity", True), "by_status": ("status", False), "open_by_verification": ("verification", True),
        "open_by_exploitability": ("exploitability", True),
    }
    return dashboard.summary(A.findings(spark, sf), sections)


def _file_states(spark, sf):
    n = F.col("size")
    status = F.when(n > 8000, "SKIPPED_SIZE").when(F.col("doc_id") % 10 == 1, "SKIPPED_BINARY").when(F.col("doc_id") % 10 == 2, "PARSE_ERROR")
    status = status.when(F.col("doc_id") % 10 == 3, "OTHER").otherwise("ANALYZED")
    return A.files(spark, sf).select("doc_id", status.alias("status"))


def _results(spark, sf):
    kinds = ["RESOLVED", "STILL_OPEN", "NOT_REPRODUCED", "NOT_TESTED", "NEW", "REGRESSION"]
    k = F.col("finding_id")
    return A.findings(spark, sf).select("finding_id", "severity", A._choice(k % 7, [*kinds, "NEW"]).alias("result"))


def _rules(spark, sf):
    r = A.reports(spark, sf)
    return dashboard.rule_levels(r.select(F.col("vuln_class").alias("rule_id"), F.col("rule_id").alias("title"), "severity", "ord"))


def _canonical(spark, sf):
    out = dashboard.first_in_groups(A.reports(spark, sf), "path", [*dashboard.canonical_order(), "ord"], 5)
    return out.select("path", "line", "severity", "confidence", "rule_id", "place")


def _contributions(spark, sf):
    return dashboard.risk_contributions(A.findings(spark, sf), "project_id", O.finding_risk(), 200)


def _blocking(spark, sf):
    f = A.findings(spark, sf).where(O.active() & F.col("severity").isin("CRITICAL", "HIGH") & (F.col("verification") == "DETECTED"))
    return dashboard.first_in_groups(f, "project_id", ["finding_id"], 50).select("project_id", "finding_id", "place")


def _history(spark, sf):
    o = A.occurrences(spark, sf)
    out = dashboard.first_in_groups(o, "path", [F.desc("seen_at"), "finding_id", "line", "scanner", "vuln_class"], 20)
    return out.select("path", "finding_id", "line", "scanner", "vuln_class", "place")


def _markers(spark, sf):
    f = A.findings(spark, sf).select("finding_id", "severity", "status")
    return dashboard.code_markers(A.occurrences(spark, sf), f, "src/p7.py").select("finding_id", "line", "severity", "status", "vuln_class")


def _audit(spark, sf):
    out = access.audit_events(A.audit(spark, sf), A.members(spark, sf), 2, action="p", outcome="success", actor="1")
    return out.select("event_id", "action", "actor_label")


def _triagers(spark, sf):
    return access.permitted(A.members(spark, sf), "finding:triage").groupBy("organization_id", "role").agg(F.count("*").alias("n"))


def _seen(spark, sf):
    """What one user of each role sees."""
    members = A.members(spark, sf)
    out = [
        access.projects_seen(A.projects(spark, sf), members, members, u).select(F.lit(u).cast("long").alias("user_id"), "project_id") for u in (10, 11, 12, 13, 14)
    ]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


def _roles(spark, sf):
    m = A.members(spark, sf)
    rows = access.present(A.organizations(spark, sf)).select("organization_id")
    return m.join(F.broadcast(rows), "organization_id", "left_semi").groupBy("role").agg(F.count("*").alias("n"))


def _git_urls(spark, sf):
    """Addresses of pages as repositories: every third with a user, every fifth with a query, every seventh with http."""
    k = F.col("page_id")
    path = F.regexp_extract("url", "^https?://[^/]*(/[^?#]*)", 1)
    host = F.when(k % 11 == 0, "git.example.net").otherwise("Git.Example.org")
    url = F.concat(
        F.when(k % 7 == 0, "http://").otherwise("https://"), F.when(k % 3 == 0, "me@").otherwise(""), host, path, F.when(k % 5 == 0, "?x=1").otherwise("")
    )
    return A.table(spark, sf, "pages").select("page_id", access.git_url(url, ["git.example.org"]).alias("repository"))


def _excludes(spark, sf):
    d = A.table(spark, sf, "documents")
    text = F.substring(F.regexp_replace("text", "[\\r\\n]", "/"), 1, 210)
    return d.select("doc_id", access.exclude_pattern_ok(F.when(F.col("doc_id") % 2 == 0, text).otherwise(F.substring(text, 1, 40))).alias("ok"))


def _kinds(spark, sf):
    o = A.occurrences(spark, sf)
    k = F.col("finding_id")
    rows = o.select(
        "finding_id", A._choice(k % 4, ["SECRET", "DEPENDENCY", "LLM_TEST", "SAST"]).alias("source_kind"), "vuln_class", "path",
        F.col("snippet").alias("secret_hash"), F.lit("npm").alias("ecosystem"), F.col("vuln_class").alias("package_name"),
        F.when(k % 8 == 1, F.col("scanner")).alias("advisory_id"), F.col("scanner").alias("rule_id"), F.lit(None).cast("string").alias("target_scope"),
        F.lit("APPSEC").alias("engine"), F.lit(None).cast("string").alias("function_name"), "snippet",
    )
    rows = rows.withColumn("fingerprint", identity.fingerprint())
    rows = rows.withColumn("scoped", identity.scoped(k % 9, F.col("fingerprint")))
    return rows.groupBy("source_kind", "fingerprint").agg(F.count("*").alias("n"), F.min("scoped").alias("first_scoped"))


def _keyed(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.select("doc_id", identity.keyed_hash(F.substring(F.coalesce("text", F.lit("")), 1, 64), _KEY).alias("digest"))


def _merged(spark, sf):
    out = merge.merge_groups(A.reports(spark, sf))
    return out.withColumns({"scanners": F.array_join("scanners", ","), "cwe": F.array_join("cwe", ",")}).select(
        "group_id", "rule_id", "merged", "confidence", "severity", "exploitability", "raised", "scanners", "cwe", "reason"
    )


def _requests(spark, sf):
    k = F.col("finding_id")
    statuses = ["OPEN", "IN_PROGRESS", "RESOLVED", "REOPENED", "FALSE_POSITIVE", "ACCEPTED_RISK"]
    return A.findings(spark, sf).select(
        "finding_id", A._choice(k % 6, statuses).alias("new_status"), A._choice(k % 5, ["CONFIRMED", "FALSE_POSITIVE", "AI_SUGGESTED", "DETECTED", "NOT_TESTED"]).alias("new_verification"),
        A._choice(k % 7, ["VIEWER", "DEVELOPER", "SECURITY_ANALYST", "ADMIN", "OWNER"]).alias("role"), F.when(k % 4 != 0, "because").alias("reason"), F.lit(A.AS_OF).alias("at"),
    )


def _status(spark, sf):
    out = lifecycle.change_status(A.findings(spark, sf), _requests(spark, sf))
    return out.groupBy("status", "verification", "error").agg(F.count("*").alias("n"), F.count("resolved_at").alias("resolved"))


def _verification(spark, sf):
    out = lifecycle.change_verification(A.findings(spark, sf), _requests(spark, sf))
    return out.groupBy("status", "verification", "error").agg(F.count("*").alias("n"))


def _transitions(spark, sf):
    s = A.scans(spark, sf).select(F.col("project_id").alias("scan_id"), F.col("finished_at").alias("at"), F.col("scan_id").alias("ord"), "status")
    return lifecycle.scan_transitions(s).groupBy("before", "status", "allowed").agg(F.count("*").alias("n"))


def _numbers(spark, sf):
    f = A.findings(spark, sf)
    k = F.col("finding_id")
    fp = (k % 1000).cast("string").alias("fingerprint")
    old = f.where(k % 3 == 0).groupBy("project_id", fp).agg(F.min("finding_id").alias("number"))
    return lifecycle.persistent_numbers(old, f.select("project_id", fp, k.alias("ord")))


def _retest_rows(spark, sf):
    items = _results(spark, sf).withColumn("ord", F.col("finding_id"))
    out = lifecycle.retest_rows(items, A.findings(spark, sf).drop("severity"), ["CRITICAL", "HIGH"], A.AS_OF)
    return out.groupBy("result", "status", "new_blocking").agg(F.count("*").alias("n"), F.count("resolved_at").alias("resolved"))


def _remediations(spark, sf):
    k = F.col("finding_id")
    r = A.findings(spark, sf).select(k.alias("remediation_id"), k.alias("finding_id"), A._choice(k % 3, ["APPLIED", "PROPOSED", "APPLIED"]).alias("status"))
    out = lifecycle.verified_remediations(r, _results(spark, sf).where("finding_id % 2 = 0"))
    return out.groupBy("status", "retest_result").agg(F.count("*").alias("n"))


def _fingerprints_at(spark, sf, condition):
    rows = A.occurrences(spark, sf).where(condition)
    return rows.select(_fingerprint(rows).alias("fingerprint")).distinct()


def _regressions(spark, sf):
    return lifecycle.regression_history(
        _fingerprints_at(spark, sf, "seen_at < timestamp'1995-03-01'"), _fingerprints_at(spark, sf, "seen_at < timestamp'1995-09-01'"),
        _fingerprints_at(spark, sf, "finding_id % 50 = 0"),
    )


def _policies(spark, sf):
    p = A.projects(spark, sf)
    own = p.where("project_id % 4 = 1").select("project_id", F.concat(F.lit("own "), "name").alias("policy"))
    wide = A.organizations(spark, sf).where("organization_id % 2 = 0").select("organization_id", F.concat(F.lit("of "), "name").alias("policy"))
    return lifecycle.policy_of(p, own, wide, F.lit("default"))


# The classes' main weaknesses; those of the other classes are their lowest numbers.
_FIRST = {c: n for n, c in reversed(adapters.CWE_CLASSES.items())} | {"xss": "CWE-79", "command_injection": "CWE-78", "hardcoded_secret": "CWE-259"}


def _catalog(spark):
    rows = [(c, [n]) for c, n in _FIRST.items()]
    return spark.createDataFrame(rows, "vuln_class string, class_cwe array<string>")


def _bandit(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    code = F.concat((size - 1).cast("string"), F.lit(" x = 1\n"), size.cast("string"), F.lit(" "), F.col("p_type"), F.lit("\n"))
    item = F.struct(
        F.concat(F.lit("B"), (k % 8 + 601).cast("string")).alias("test_id"), F.col("p_name").alias("test_name"), F.concat(F.lit('found token = "ghp_'), F.repeat(F.lit("a1B2c3D4e5F6"), 3), F.lit('" in '), "p_brand").alias("issue_text"),
        A._choice(k % 4, ["HIGH", "MEDIUM", "LOW", "UNDEFINED"]).alias("issue_severity"), A._choice(k % 3, ["HIGH", "MEDIUM", "LOW"]).alias("issue_confidence"),
        F.struct((k % 100 + 70).alias("id")).alias("issue_cwe"), F.concat(F.lit("./src/"), F.col("p_name"), F.lit(".py")).alias("filename"),
        size.alias("line_number"), (k % 9).alias("col_offset"), code.alias("code"),
    )
    reports = A.table(spark, sf, "part").select(k.alias("report_id"), F.to_json(F.struct(F.array(item).alias("results"))).alias("json"))
    out = adapters.bandit(reports, _catalog(spark))
    return out.select("report_id", "rule_id", "vuln_class", "severity", "confidence", "path", "line", "col", "snippet", "message", F.array_join("cwe", ",").alias("cwe"))


def _semgrep(spark, sf):
    k = F.col("p_partkey")
    one = F.concat(F.lit('"CWE-'), (k % 100 + 70).cast("string"), F.lit(': a weakness"'))
    cwe = F.when(k % 2 == 0, one).otherwise(F.concat(F.lit('["none", '), one, F.lit("]")))
    json = F.concat(
        F.lit('{"results": [{"check_id": "a.b.no-'), F.lower("p_brand"), F.lit('", "path": "src/x.py", "start": {"line": '), F.col("p_size").cast("string"),
        F.lit(', "col": 3}, "extra": {"message": "m", "severity": "'), A._choice(k % 3, ["ERROR", "WARNING", "INFO"]), F.lit('", "lines": " y = \\"sk_live_aB3dE6gH9jK2mN5pQ8sT1v\\" ", "metadata": {"cwe": '),
        cwe, F.lit(', "confidence": "low"}}}]}'),
    )
    out = adapters.semgrep(A.table(spark, sf, "part").select(k.alias("report_id"), json.alias("json")), _catalog(spark))
    return out.select("report_id", "rule_id", "vuln_class", "title", "severity", "confidence", "path", "line", "snippet", F.array_join("cwe", ",").alias("cwe"))


def _gitleaks(spark, sf):
    k = F.col("p_partkey")
    item = F.struct(
        F.col("p_type").alias("RuleID"), F.when(k % 2 == 0, F.col("p_name")).alias("Description"), F.concat(F.lit("./"), "p_name").alias("File"),
        F.col("p_size").alias("StartLine"), F.lit(1).alias("StartColumn"),
    )
    reports = A.table(spark, sf, "part").select(k.alias("report_id"), F.to_json(F.array(item)).alias("json"))
    return adapters.gitleaks(reports, _catalog(spark)).select("report_id", "rule_id", "title", "path", "line", F.array_join("cwe", ",").alias("cwe"))


def _osv(spark, sf):
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    text = F.concat(
        F.when(F.col("s_suppkey") % 2 == 0, "[").otherwise(""), F.lit('{"id": "ADV-'), k, F.lit('", "summary": "'), F.col("s_name"), F.lit('\\nmore", "aliases": ["CVE-'), k,
        F.lit('"], '), F.when(F.col("s_suppkey") % 5 == 0, '"withdrawn": "2020-01-01", ').otherwise(""), F.lit('"database_specific": {"severity": "'),
        A._choice(F.col("s_suppkey") % 3, ["moderate", "high", "unknown"]),
        F.lit('"}, "affected": [{"package": {"ecosystem": "PyPI", "name": "My_Pkg"}, "ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "0"}, {"fixed": "'), n,
        F.lit('.1"}]}]}, {"package": {"ecosystem": "PyPI", "name": "my.pkg"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "'), n,
        F.lit('.2"}]}], "ecosystem_specific": {"severity": "low"}}]}'), F.when(F.col("s_suppkey") % 2 == 0, "]").otherwise(""),
    )
    out = adapters.osv_advisories(adapters.osv_records(A.table(spark, sf, "supplier").select(text.alias("json"))))
    return out.select(
        "advisory_id", "package", "summary", "severity", F.array_join("aliases", ",").alias("aliases"), F.array_join("affected_ranges", "; ").alias("affected_ranges"),
        F.array_join("fixed_versions", ",").alias("fixed_versions"),
    )


def _scanners(spark):
    rows = [(1, "sast", "ran", None, 5), (2, "bandit", "unavailable", "not installed", 0), (3, "custom", "failed", None, 0)]
    return spark.createDataFrame(rows, "ord int, scanner string, status string, detail string, findings int")


def _lined_files(spark, sf):
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    f = A.files(spark, sf).select("doc_id", "language", lines.cast("long").alias("lines"))
    return f.join(_file_states(spark, sf), "doc_id")


def _scope(spark, sf):
    out = reports.scope(_lined_files(spark, sf), _scanners(spark))
    lang = F.transform("languages", lambda x: F.concat_ws(":", x["language"], x["files"].cast("string"), x["lines"].cast("string")))
    runs = F.transform("scanners", lambda x: F.concat_ws(":", x["name"], x["status"]))
    return out.select("files_total", "files_analyzed", "lines_analyzed", F.array_join(lang, ",").alias("languages"), F.array_join(runs, ",").alias("scanners"))


def _limits(spark, sf):
    deps = A.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, "NOT_VERIFIED").otherwise("VULNERABLE").alias("vuln_status"))
    return reports.limitations(_file_states(spark, sf), _scanners(spark), deps, A.findings(spark, sf), True)


def _views(spark, sf):
    k = F.col("finding_id")
    o = A.occurrences(spark, sf).select(
        "finding_id", F.when(k % 5 != 0, F.col("path")).alias("path"), F.when(k % 3 != 0, F.col("line")).alias("line"),
        F.array(F.concat(F.lit("https://a/"), "vuln_class"), F.lit("ftp://b"), F.lit("javascript:x"), F.lit(None)).alias("references"),
    )
    rows = reports.finding_views(o).groupBy("location", F.array_join("references", ",").alias("references"))
    return rows.agg(F.count("*").alias("n"))


def _secrets(spark, sf):
    text = F.regexp_replace("text", 'token = "([0-9a-f]{36})', 'token = "ghp_$1')
    found = secrets.scan_secrets(A.files(spark, sf).select("doc_id", "path", text.alias("text")))
    out = reports.secret_findings(found, identity.keyed_hash(F.col("value"), _KEY))
    return out.select("path", "line", "col", "rule_id", "masked", "secret_hash", F.array_join("tags", ",").alias("tags"))


def _lines(spark, sf):
    """Each part's name is looked for in the document of its number."""
    deps = A.table(spark, sf, "part").select("p_partkey", F.upper(F.substring("p_name", 2, 3)).alias("name"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("manifest_path"))
    texts = A.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    return reports.manifest_lines(deps, texts).select("p_partkey", "line")


def _package_findings(spark, sf):
    k = F.col("p_partkey")
    none = F.array().cast("array<string>")
    deps = A.table(spark, sf, "part").select(
        F.col("p_name").alias("name"), (k % 7).cast("string").alias("version"), F.lit("PyPI").alias("ecosystem"), F.concat(F.lit("m"), k.cast("string")).alias("manifest_path"),
        (k % 2 == 0).alias("direct"), (k % 50).alias("advisory_id"),
    ).withColumn("advisory_id", F.concat(F.lit("A-"), F.col("advisory_id").cast("string")))
    n = F.col("s_suppkey")
    advisories = A.table(spark, sf, "supplier").where("s_suppkey < 40").select(
        F.concat(F.lit("A-"), n.cast("string")).alias("advisory_id"), F.array(F.lit("GHSA-1"), F.when(n % 2 == 0, F.concat(F.lit("CVE-"), n.cast("string"))).otherwise("x")).alias("aliases"),
        F.lit("HIGH").alias("severity"), F.when(n % 3 == 0, "").otherwise(F.col("s_name")).alias("summary"), F.when(n % 4 == 0, F.array(F.lit("<2"), F.lit(">=3, <4"))).otherwise(none).alias("affected_ranges"),
        F.when(n % 5 == 0, none).otherwise(F.array(F.lit("2"), F.lit("4"))).alias("fixed_versions"), none.alias("references"),
    )
    out = reports.dependency_findings(deps, advisories)
    return out.select("path", "title", "description", "recommendation", F.array_join("tags", ",").alias("tags"))


def _explained(spark, sf):
    k = F.col("finding_id")
    kind = A._choice(k % 6, ["dataflow", "secret", "dependency", "criterion", "pattern", "other"])
    pairs = {"source": F.when(k % 12 == 0, "request"), "sink": F.lit("exec"), "secret_type": F.lit("Key"), "masked": F.lit("ab**"), "detector": F.lit("d"), "name": F.lit("pkg"),
             "version": F.lit("1"), "advisory_id": F.lit("A"), "fixed_versions": F.when(k % 4 == 0, "2, 3"), "detail": F.lit("why")}
    data = F.map_filter(F.create_map(*(x for n, v in pairs.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())
    hop = lambda n: F.struct(F.lit("p").alias("path"), F.lit(n).alias("line"), F.lit("" if n == 2 else "goes on").alias("note"))
    evidence = F.array(F.struct(kind.alias("kind"), F.lit("seen").alias("summary"), data.alias("data"), F.array(hop(1), hop(2), hop(3)).alias("steps")))
    f = A.findings(spark, sf).select("finding_id", "severity", "confidence", "exploitability", F.lit("xss").alias("vuln_class"), F.lit("t").alias("title"),
                                     F.lit("a.py").alias("path"), F.lit(9).alias("line"), evidence.alias("evidence"))
    text = F.array_join(F.transform("steps", lambda s: F.concat(s["number"].cast("string"), F.lit(" "), s["title"], F.lit(": "), s["detail"])), "; ")
    return reports.explained(f).groupBy(text.alias("steps")).agg(F.count("*").alias("n"))


def _file_views(spark, sf):
    text = F.regexp_replace("text", 'token = "([0-9a-f]{36})', 'token = "ghp_$1')
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(text, F.lit("\x00"))).otherwise(text)
    f = A.files(spark, sf).select("doc_id", "path", text.alias("text"))
    return reports.file_views(f, 5000).select("doc_id", "binary", "truncated", "redacted", F.sha2("text", 256).alias("shown_sha256"))


def _stored(spark, sf):
    k, o = F.col("finding_id"), A.occurrences(spark, sf)
    key = F.concat_ws("/", k.cast("string"), "path", F.col("line").cast("string"), "scanner", "vuln_class")
    rows = o.groupBy("finding_id", "path", "line", "scanner", "vuln_class").agg(F.min("snippet").alias("snippet")).withColumn("occurrence_id", key)
    seen = rows.select(
        "occurrence_id", (k % 7).alias("scan_id"), "finding_id", F.when(k % 4 != 0, F.col("path")).alias("path"), "line", F.lit("LOW").alias("severity"), F.lit("HIGH").alias("confidence"), "snippet"
    )
    proof = rows.select("occurrence_id", F.explode(F.array(F.lit(2), F.lit(1))).alias("ord"), "scanner").where("scanner <> 's4'").select(
        "occurrence_id", F.col("ord").cast("long").alias("ord"), F.concat(F.lit("k"), F.col("ord").cast("string")).alias("kind"), F.col("scanner").alias("source"), F.lit("x").alias("summary")
    )
    own = A.findings(spark, sf).select("finding_id", F.lit("t").alias("title"), "status", "verification", F.lit("own").alias("path"))
    told = F.array_join(F.transform("evidence", lambda e: F.concat(e["kind"], F.lit("@"), e["source"])), ",")
    out = reports.stored_scan(seen, own, proof).groupBy("scan_id", "status", "verification", "severity", "confidence", "path", told.alias("evidence"))
    return out.agg(F.count("*").alias("n"))


def _imported(spark, sf):
    """Findings saved as JSON with the documents' tokens in them, read back and taken in."""
    value = F.concat(F.lit("ghp_"), F.regexp_extract("text", 'token = "([0-9a-f]{40})', 1))
    d = A.files(spark, sf).where("text rlike 'token = \"[0-9a-f]{40}'").select("doc_id", value.alias("v"))
    text = F.concat(
        F.lit('{"target": "'), F.col("doc_id").cast("string"), F.lit('", "findings": [{"rule_id": "r", "location": {"path": "a.py", "start_line": 1, "snippet": "key '), "v",
        F.lit('"}, "evidence": [{"kind": "k", "source": "bandit", "summary": "found '), "v", F.lit('"}]}]}'),
    )
    saved = d.select(F.from_json(text, f"struct<{reports.SAVED.replace(' string', ':string', 1).replace(' array', ':array', 1)}>").alias("x")).select("x.*")
    out = reports.imported(saved)
    return out.select("target", "rule_id", "path", "line", "snippet", F.col("evidence")[0]["source"].alias("source"), F.col("evidence")[0]["summary"].alias("summary"))


QUERIES: dict[str, Query] = {
    "file_views": _file_views,
    "stored_scans": _stored,
    "imported_findings": _imported,
    "report_scope": _scope,
    "report_limitations": _limits,
    "finding_views": _views,
    "secret_findings": _secrets,
    "manifest_lines": _lines,
    "dependency_findings": _package_findings,
    "explained_findings": _explained,
    "top_findings": _top,
    "recent_scans": _recent,
    "scan_list": _scan_list,
    "latest_scan": _latest,
    "dashboard_projects": _projects,
    "dashboard_summary": _summary,
    "skipped_files": lambda spark, sf: dashboard.skipped_files(_file_states(spark, sf)),
    "skipped_sentence": lambda spark, sf: dashboard.skipped_sentence(_file_states(spark, sf)),
    "retest_summary": lambda spark, sf: dashboard.retest_summary(_results(spark, sf)),
    "gate_severities": lambda spark, sf: dashboard.gate_severities(A.findings(spark, sf), "project_id"),
    "rule_levels": _rules,
    "canonical_order": _canonical,
    "risk_contributions": _contributions,
    "blocking_findings": _blocking,
    "occurrence_history": _history,
    "code_markers": _markers,
    "organization_audit": _audit,
    "permitted_members": _triagers,
    "projects_visible": _seen,
    "organization_members": lambda spark, sf: access.members_of(A.members(spark, sf), A.users(spark, sf), 2),
    "owner_counts": lambda spark, sf: access.owners(A.members(spark, sf)),
    "roles_in_organizations": _roles,
    "git_urls": _git_urls,
    "exclude_patterns": _excludes,
    "fingerprint_kinds": _kinds,
    "keyed_hashes": _keyed,
    "merged_reports": _merged,
    "status_changes": _status,
    "verification_changes": _verification,
    "scan_transitions": _transitions,
    "persistent_numbers": _numbers,
    "retest_rows": _retest_rows,
    "remediation_outcomes": _remediations,
    "regression_history": _regressions,
    "gate_policies": _policies,
    "bandit_findings": _bandit,
    "semgrep_findings": _semgrep,
    "gitleaks_findings": _gitleaks,
    "osv_advisories": _osv,
}

_PROJ = "pr as (select cast(n_nationkey as bigint) as project_id, n_name as name, cast(n_regionkey as bigint) as organization_id from nation)"
_MEM = f"""{_PROJ}, m as (
    select c_custkey as user_id, organization_id, project_id,
        case c_custkey % 5 when 0 then 'OWNER' when 1 then 'ADMIN' when 2 then 'SECURITY_ANALYST' when 3 then 'DEVELOPER' else 'VIEWER' end as role
    from customer join pr on c_nationkey = project_id)"""
_REP = f"""{_F}, {_O}, rp as (
    select path || '|' || line || '|' || vuln_class as group_id, scanner || '-' || finding_id as ord, scanner || ':' || finding_id as rule_id, vuln_class, path, line,
        severity, confidence, exploitability, scanner, sr, cr,
        case exploitability when 'PROVEN_DATAFLOW' then 3 when 'LIKELY' then 2 when 'POSSIBLE' then 1 else 0 end as er,
        ['CWE-' || (finding_id % 3), 'CWE-' || (finding_id % 5)] as cwe,
        row(-cast(finding_id % 11 = 0 as integer), -cast(finding_id % 6 = 0 as integer), -cast(scanner = 's0' as integer), -cr, -sr, scanner || '-' || finding_id) as best
    from o join g using (finding_id))"""
_RES = """rs as (select *, case finding_id % 7 when 0 then 'RESOLVED' when 1 then 'STILL_OPEN' when 2 then 'NOT_REPRODUCED'
    when 3 then 'NOT_TESTED' when 4 then 'NEW' when 5 then 'REGRESSION' else 'NEW' end as result from g)"""
_REQ = """rq as (select *,
    case finding_id % 6 when 0 then 'OPEN' when 1 then 'IN_PROGRESS' when 2 then 'RESOLVED' when 3 then 'REOPENED' when 4 then 'FALSE_POSITIVE' else 'ACCEPTED_RISK' end as ns,
    case finding_id % 5 when 0 then 'CONFIRMED' when 1 then 'FALSE_POSITIVE' when 2 then 'AI_SUGGESTED' when 3 then 'DETECTED' else 'NOT_TESTED' end as nv,
    finding_id % 7 >= 2 and finding_id % 7 < 4 or finding_id % 7 >= 4 as triage, finding_id % 4 <> 0 as said from g)"""
_WORST = "case max(sr) when 4 then 'CRITICAL' when 3 then 'HIGH' when 2 then 'MEDIUM' when 1 then 'LOW' else 'INFO' end"
_STATES = """fs as (select case when n_chars > 8000 then 'SKIPPED_SIZE' when doc_id % 10 = 1 then 'SKIPPED_BINARY' when doc_id % 10 = 2 then 'PARSE_ERROR'
    when doc_id % 10 = 3 then 'OTHER' else 'ANALYZED' end as status from documents),
    sk as (select status, count(*) as n, case status when 'SKIPPED_SIZE' then 'too large' when 'SKIPPED_BINARY' then 'binary' else 'could not be parsed' end as reason
        from fs where status not in ('OTHER', 'ANALYZED') group by 1)"""
_CLASS_SQL = "case {0} " + " ".join(f"when {n[4:]} then '{c}'" for n, c in adapters.CWE_CLASSES.items()) + " end"
_FIRST_SQL = "case {0} " + " ".join(f"when '{c}' then '{n}'" for c, n in _FIRST.items()) + " end"
_PADS = {name: bytes(x ^ pad for x in _KEY.ljust(64, b"\0")).hex() for name, pad in (("inner", 0x36), ("outer", 0x5C))}

ORACLE: dict[str, str] = {
    "file_views": """with t as (select doc_id, doc_id % 9 = 0 as b, regexp_replace(text, 'token = "([0-9a-f]{36})', 'token = "ghp_\\1', 'g') || case when doc_id % 9 = 0 then chr(0) else '' end as x
            from documents where text is not null),
        v as (select doc_id, b, length(x) > 5000 as more, substr(x, 1, 5000) as x from t), m as (select *, regexp_replace(x, 'ghp_[0-9a-f]{32,}([0-9a-f]{4})', 'ghp_************\\1', 'g') as y from v)
        select doc_id, b as "binary", more as truncated, not b and x <> y as redacted, case when not b then sha256(y) end as shown_sha256 from m""",
    "stored_scans": f"""with {_F}, {_O}, x as (select distinct finding_id, path, line, scanner, vuln_class from o)
        select finding_id % 7 as scan_id, status, verification, 'LOW' as severity, 'HIGH' as confidence, case when finding_id % 4 <> 0 then path else 'own' end as path,
            case when scanner = 's4' then '' else 'k1@' || scanner || ',k2@' || scanner end as evidence, count(*) as n from x join g using (finding_id) group by all""",
    "imported_findings": """with d as (select doc_id, regexp_extract(text, 'token = "([0-9a-f]{40})', 1) as v from documents where regexp_matches(text, 'token = "[0-9a-f]{40}'))
        select cast(doc_id as varchar) as target, 'r' as rule_id, 'a.py' as path, 1 as line, 'key ghp_************' || right(v, 4) as snippet, 'cli:bandit' as source,
            'found ghp_************' || right(v, 4) as summary from d""",
    "report_scope": f"""with {_STATES}, l as (select lang as language, len(string_split(coalesce(text, ''), chr(10))) as lines,
            n_chars <= 8000 and doc_id % 10 not in (1, 2, 3) as done from documents),
        g as (select language, count(*) filter (done) as n, cast(sum(lines) filter (done) as bigint) as lines from l where language is not null group by 1)
        select (select count(*) from l) as files_total, (select count(*) from l where done) as files_analyzed, (select cast(sum(lines) as bigint) from l where done) as lines_analyzed,
            string_agg(language || ':' || n || ':' || lines, ',' order by language) as languages, 'Static analysis:ran,Bandit:unavailable,custom:failed' as scanners from g where n > 0""",
    "report_limitations": f"""with {_F}, {_STATES}
        select 1 as ord, 'Code was read, not run: flaws may be missed, and harmless code may be reported.' as text
        union all select 2, 'What the code is for, and where it runs, was not judged.'
        union all select 3, 'A report tells what was found on the day of the scan; it certifies nothing and is no promise of safety.'
        union all select 4, 'Only a part of the code was submitted; the rest was not looked at.'
        union all select 5, 'Bandit unavailable: not installed' union all select 5, 'custom failed.'
        union all select 6, cast(sum(n) as varchar) || ' file(s) were not fully analysed (' || string_agg(n || ' ' || reason, ', ' order by status) || ').' from sk
        union all select 8, count(*) || ' dependencies were not compared.' from part where p_partkey % 3 = 0
        union all select 9, count(*) || ' findings have no proof of an exploit.' from g where exploitability in ('POSSIBLE', 'THEORETICAL')
        union all select 10, count(*) || ' findings rest on a model''s word only.' from g where verification = 'AI_SUGGESTED'""",
    "finding_views": f"""with {_O}, x as (select case when finding_id % 5 <> 0 then path end as path, case when finding_id % 3 <> 0 then line end as line, vuln_class from o)
        select case when path is not null and coalesce(line, 0) <> 0 then concat_ws(':', path, line) else coalesce(path, '') end as location, 'https://a/' || vuln_class as "references", count(*) as n
        from x group by 1, 2""",
    "secret_findings": f"""with t as (select source || '/' || doc_id || '.txt' as path, doc_id, text from documents where regexp_matches(text, 'token = "[0-9a-f]{{36}}')),
        l as (select path, unnest(string_split(text, chr(10))) as x, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line from t),
        v as (select path, line, instr(x, 'token = "') + 9 as col, 'ghp_' || regexp_extract(x, 'token = "([0-9a-f]+)"', 1) as v from l where regexp_matches(x, 'token = "[0-9a-f]{{36}}'))
        select path, cast(line as integer) as line, cast(col as integer) as col, 'SECRET-GITHUB-TOKEN' as rule_id, substr(v, 1, 4) || repeat('*', 12) || right(v, 4) as masked,
            substr(sha256(unhex('{_PADS["outer"]}') || unhex(sha256(unhex('{_PADS["inner"]}') || encode(v)))), 1, 32) as secret_hash, 'secret,github-token' as tags from v""",
    "manifest_lines": """with d as (select p_partkey, lower(substr(p_name, 2, 3)) as name, text from part left join documents on doc_id = p_partkey),
        l as (select p_partkey, name, unnest(string_split_regex(lower(text), '\\r\\n|\\n|\\r')) as x, generate_subscripts(string_split_regex(lower(text), '\\r\\n|\\n|\\r'), 1) as i from d),
        f as (select p_partkey, min(i) as line from l where contains(x, name) group by 1)
        select p_partkey, cast(line as integer) as line from part left join f using (p_partkey)""",
    "dependency_findings": """with d as (select p_name as name, p_partkey % 7 as version, 'm' || p_partkey as path, p_partkey, p_partkey % 50 as n from part),
        a as (select *, s_suppkey as k from supplier where s_suppkey < 40)
        select path, name || ' ' || version || ' - A-' || k || case when k % 2 = 0 then ' (CVE-' || k || ')' else '' end as title,
            case when k % 3 = 0 then 'A-' || k else s_name end || '. Affected: ' || case when k % 4 = 0 then '<2; >=3, <4' else 'see advisory' end
                || case when k % 5 = 0 then '. No version with a fix so far.' else '. Fixed in: 2, 4.' end as description,
            case when k % 5 <> 0 then 'Move ' || name || ' to 4 or a later version and scan again.' end as recommendation,
            'dependency,pypi,' || case when p_partkey % 2 = 0 then 'direct' else 'transitive' end as tags from d join a on k = n""",
    "explained_findings": f"""with {_F}, x as (select case finding_id % 6
            when 0 then case when finding_id % 12 = 0 then '1 Input from outside: request; 2 The value moves on: p:2; 3 The value arrives at a sink: exec at a.py:9; 4 '
                else '1 Origin not found: No source was found; this lowers the confidence.; 2 goes on: p:1; 3 The value moves on: p:2; 4 The value arrives at a sink: exec at a.py:9; 5 ' end
            when 1 then '1 Credential in a file: Key ab** at a.py:9; 2 Format recognised: d; 3 '
            when 2 then '1 Package in use: pkg@1; 2 An advisory names this version: A; 3 Way out: '
                || case when finding_id % 4 = 0 then 'Fixed in 2, 3' else 'No version with a fix so far' end || '; 4 '
            when 3 then '1 seen: why; 2 ' when 4 then '1 Construct with a known risk: seen; 2 ' else '1 Construct with a known risk: t; 2 ' end
            || 'Potential xss: Severity ' || severity || ', confidence ' || confidence || ', exploitability ' || lower(replace(exploitability, '_', ' ')) || '.' as steps from g)
        select steps, count(*) as n from x group by 1""",
    "top_findings": f"""with {_F} select finding_id, project_id, severity, round(inherent, 3) as risk_score from g where live
        order by risk_score desc, finding_id limit 10""",
    "recent_scans": f"""with {_S} select scan_id, status, finished_at, c_name as repository_name
        from (select * from s order by finished_at desc, scan_id desc limit 10) join events on event_id = scan_id left join customer on c_custkey = user_id""",
    "scan_list": f"""with {_S}, x as (select * from s where project_id = 3 and status = 'COMPLETED')
        select scan_id, finished_at, (select count(*) from x) as total from x order by finished_at desc, scan_id desc limit 10 offset 10""",
    "latest_scan": f"""with {_S} select project_id, max(finished_at) as finished_at, arg_max(scan_id, (finished_at, scan_id)) as scan_id,
        arg_max(status, (finished_at, scan_id)) as status from s group by 1""",
    "dashboard_projects": f"""with {_F}, {_S}, {_PROJ},
        d as (select project_id, max(finished_at) as last_scan_at, arg_max(risk_index, (finished_at, scan_id)) as risk_index from s where status = 'COMPLETED' group by 1),
        n as (select project_id, count(*) as open from g where live group by 1)
        select project_id, name, last_scan_at, risk_index, coalesce(open, 0) as open from pr left join d using (project_id) left join n using (project_id)""",
    "dashboard_summary": f"""with {_F}, a as (
            select 'open_by_severity' as section, severity as value, count(*) as n from g where live group by 2
            union all select 'by_status', status, count(*) from g group by 2
            union all select 'open_by_verification', verification, count(*) from g where live group by 2
            union all select 'open_by_exploitability', exploitability, count(*) from g where live group by 2
            union all select 'open_by_severity', v, 0 from (values ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) t(v))
        select section, value, cast(sum(n) as bigint) as n from a group by 1, 2""",
    "skipped_files": f"with {_STATES} select * from sk",
    "skipped_sentence": f"""with {_STATES} select cast(sum(n) as varchar) || ' file(s) were not fully analysed ('
        || string_agg(n || ' ' || reason, ', ' order by status) || ').' as limitation from sk""",
    "retest_summary": f"""with {_F}, {_RES}, c as (select count(*) filter (result = 'RESOLVED') as resolved, count(*) filter (result = 'STILL_OPEN') as still_open,
            count(*) filter (result = 'NOT_REPRODUCED') as not_reproduced, count(*) filter (result = 'NOT_TESTED') as not_tested,
            count(*) filter (result = 'NEW') as new, count(*) filter (result = 'REGRESSION') as regressions from rs)
        select *, resolved + still_open + not_reproduced + not_tested as previous_findings, still_open + not_tested as remaining,
            case when regressions > 0 then 'FAIL' else 'PASS' end as regression_check from c""",
    "gate_severities": f"""with {_F} select project_id, count(*) filter (sr = 4) as critical, count(*) filter (sr = 3) as high, count(*) filter (sr = 2) as medium,
        count(*) filter (sr = 1) as low, count(*) filter (sr = 0) as info from g where live and verification <> 'FALSE_POSITIVE' group by 1""",
    "rule_levels": f"with {_REP} select vuln_class as rule_id, arg_min(rule_id, (ord, rule_id)) as title, {_WORST} as severity from rp group by 1",
    "canonical_order": f"""with {_REP}, x as (select *, cast(row_number() over (partition by path order by sr desc, cr desc, line, rule_id, ord) as integer) as place from rp)
        select path, line, severity, confidence, rule_id, place from x where place <= 5""",
    "risk_contributions": f"""with {_F}, x as (select project_id, finding_id, cast(round(cast(case when live then inherent else 0 end as decimal(38, 12)), 3) as double) as risk from g),
        y as (select *, cast(row_number() over (partition by project_id order by risk desc, finding_id) as integer) as place from x where risk > 0)
        select * from y where place <= 200""",
    "blocking_findings": f"""with {_F}, x as (select project_id, finding_id, cast(row_number() over (partition by project_id order by finding_id) as integer) as place
        from g where live and sr >= 3 and verification = 'DETECTED') select * from x where place <= 50""",
    "occurrence_history": f"""with {_O}, x as (select *, cast(row_number() over (
            partition by path order by seen_at desc, finding_id, line, scanner, vuln_class) as integer) as place from o)
        select path, finding_id, line, scanner, vuln_class, place from x where place <= 20""",
    "code_markers": f"with {_F}, {_O} select finding_id, line, severity, status, vuln_class from o join g using (finding_id) where path = 'src/p7.py'",
    "organization_audit": f"""with {_MEM}, own as (select user_id from m where organization_id = 2),
        e as (select event_id, case when event_id % 3 <> 0 then event_id % 5 end as organization_id, user_id, event_type || '.done' as action,
            case when event_type = 'error' then 'FAILURE' else 'SUCCESS' end as outcome, 'user' || user_id as actor_label from events)
        select event_id, action, actor_label from e where (organization_id = 2 or organization_id is null and (user_id in (select * from own)
            or event_id % 2 = 0 and event_id % 1500 in (select * from own))) and action like 'p%' and outcome = 'SUCCESS' and actor_label like '%1%'""",
    "permitted_members": f"with {_MEM} select organization_id, role, count(*) as n from m where role in ('SECURITY_ANALYST', 'ADMIN', 'OWNER') group by 1, 2",
    "projects_visible": f"""with {_MEM} select u.user_id, p.project_id from m u join pr p on p.organization_id = u.organization_id
            and (u.role in ('SECURITY_ANALYST', 'ADMIN', 'OWNER') or p.project_id = u.project_id) where u.user_id in (10, 11, 12, 13, 14)""",
    "organization_members": f"""with {_MEM} select user_id, role, lower(c_name) as email from m join customer on c_custkey = user_id
        where organization_id = 2 and user_id % 17 <> 0""",
    "owner_counts": f"with {_MEM} select organization_id, count(*) filter (role = 'OWNER') as owners from m group by 1",
    "roles_in_organizations": f"with {_MEM} select role, count(*) as n from m where organization_id <> 3 group by 1",
    "git_urls": """with p as (select page_id, regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1) as path from pages)
        select page_id, case when page_id % 7 <> 0 and page_id % 3 <> 0 and page_id % 11 <> 0 and page_id % 5 <> 0
            and regexp_matches(path, '^(/[A-Za-z0-9._-]+){2,5}/?$') then 'https://git.example.org' || regexp_replace(path, '/+$', '') end as repository from p""",
    "exclude_patterns": """with t as (select doc_id, substr(regexp_replace(text, '[\\r\\n]', '/', 'g'), 1, case when doc_id % 2 = 0 then 210 else 40 end) as p from documents)
        select doc_id, trim(p, ' ') <> '' and length(trim(p, ' ')) <= 200 and trim(p, ' ') not like '/%' and p not like '%..%' as ok from t""",
    "fingerprint_kinds": f"""with {_O}, x as (select *, case finding_id % 4 when 0 then 'SECRET' when 1 then 'DEPENDENCY' when 2 then 'LLM_TEST' else 'SAST' end as source_kind from p),
        y as (select source_kind, finding_id, case source_kind
            when 'SECRET' then sha256('secret' || chr(31) || vuln_class || chr(31) || path || chr(31) || snippet || '  ')
            when 'DEPENDENCY' then sha256('dependency' || chr(31) || 'npm' || chr(31) || lower(vuln_class) || chr(31) || scanner)
            when 'LLM_TEST' then sha256('llm' || chr(31) || '' || chr(31) || scanner) else fingerprint end as fp from x)
        select source_kind, fp as fingerprint, count(*) as n, min(sha256('repository:' || (finding_id % 9) || chr(31) || fp)) as first_scoped from y group by 1, 2""",
    "keyed_hashes": f"""select doc_id, sha256(unhex('{_PADS["outer"]}') || unhex(sha256(unhex('{_PADS["inner"]}') || encode(substr(coalesce(text, ''), 1, 64))))) as digest
        from documents""",
    "merged_reports": f"""with {_REP},
        sc as (select group_id, scanner, min(best) as b from rp group by 1, 2), sj as (select group_id, string_agg(scanner, ',' order by b) as scanners, count(*) as names from sc group by 1),
        cu as (select group_id, unnest(cwe) as c, unnest([1, 2]) as i, best from rp), cf as (select group_id, c, min(row(best, i)) as b from cu group by 1, 2),
        cj as (select group_id, string_agg(c, ',' order by b) as cwe from cf group by 1),
        a as (select group_id, arg_min(rule_id, best) as rule_id, arg_min(sr, best) as own, count(*) as merged, max(cr) as c, max(er) as e,
            coalesce(max(sr) filter (cr >= 1), max(sr)) as s from rp group by 1),
        r as (select *, merged > 1 and names >= 2 and c < 2 and e >= 2 as raised from a join sj using (group_id) join cj using (group_id))
        select group_id, rule_id, merged, ['LOW', 'MEDIUM', 'HIGH', 'CONFIRMED'][c + 1 + cast(raised as integer)] as confidence,
            ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][s + 1] as severity, ['THEORETICAL', 'POSSIBLE', 'LIKELY', 'PROVEN_DATAFLOW'][e + 1] as exploitability,
            raised, scanners, cwe, case when merged > 1 then merged || ' reports of ' || split_part(group_id, '|', 3) || ' at ' || split_part(group_id, '|', 1)
                || ':' || split_part(group_id, '|', 2) || ' by ' || replace(scanners, ',', ', ') || '.' || case when raised then ' The scanners agree: confidence one level up.' else '' end
                || case when s <> own then ' Severity ' || ['INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][s + 1] || ' is that of the worst report to be trusted.' else '' end end as reason from r""",
    "status_changes": f"""with {_F}, {_REQ}, e as (select *, case when ns = 'REOPENED' then 'invalid_status'
                when ns in ('FALSE_POSITIVE', 'ACCEPTED_RISK', 'RESOLVED') and not triage then 'forbidden'
                when ns in ('FALSE_POSITIVE', 'ACCEPTED_RISK', 'RESOLVED') and not said then 'reason_required' end as error from rq),
        d as (select error, case when error is null then ns else status end as status2,
            case when error is not null then verification when ns = 'FALSE_POSITIVE' then 'FALSE_POSITIVE'
                when status = 'FALSE_POSITIVE' and verification = 'FALSE_POSITIVE' then 'DETECTED' else verification end as verification2,
            case when error is not null then resolved_at when ns = 'RESOLVED' then timestamp '2001-08-01' when status = 'RESOLVED' then null else resolved_at end as r from e)
        select status2 as status, verification2 as verification, error, count(*) as n, count(r) as resolved from d group by 1, 2, 3""",
    "verification_changes": f"""with {_F}, {_REQ}, e as (select *, case when not triage then 'forbidden' when nv in ('AI_SUGGESTED', 'NOT_TESTED') then 'invalid_verification'
                when nv in ('CONFIRMED', 'FALSE_POSITIVE') and not said then 'reason_required' end as error from rq),
        d as (select error, case when error is not null then status when nv = 'FALSE_POSITIVE' then 'FALSE_POSITIVE' when status = 'FALSE_POSITIVE' then 'OPEN' else status end as s2,
            case when error is null then nv else verification end as v2 from e)
        select s2 as status, v2 as verification, error, count(*) as n from d group by 1, 2, 3""",
    "scan_transitions": f"""with {_S}, x as (select status, lag(status) over (partition by project_id order by finished_at, scan_id) as before from s)
        select before, status, coalesce(case when before is null then status = 'QUEUED' when before = 'QUEUED' then status in ('RUNNING', 'CANCELLED')
            when before = 'RUNNING' then status in ('COMPLETED', 'FAILED', 'CANCELLED') else false end, false) as allowed, count(*) as n from x group by 1, 2, 3""",
    "persistent_numbers": f"""with {_F}, x as (select project_id, cast(finding_id % 1000 as varchar) as fingerprint, finding_id from g),
        old as (select project_id, fingerprint, min(finding_id) as number from x where finding_id % 3 = 0 group by 1, 2),
        new as (select project_id, fingerprint, min(finding_id) as ord from x group by 1, 2),
        last as (select project_id, max(number) as last from old group by 1),
        fresh as (select project_id, fingerprint, row_number() over (partition by project_id order by ord) as nth from new anti join old using (project_id, fingerprint))
        select * from old union all select project_id, fingerprint, coalesce(last, 0) + nth from fresh left join last using (project_id)""",
    "retest_rows": f"""with {_F}, {_RES}, d as (select result, result in ('RESOLVED', 'NOT_REPRODUCED') and live as gone, status, resolved_at, sr from rs),
        e as (select result, case when gone then 'RESOLVED' when result = 'REGRESSION' then 'REOPENED' else status end as status,
            case when gone then timestamp '2001-08-01' else resolved_at end as r, result = 'NEW' and sr >= 3 as new_blocking from d)
        select result, status, new_blocking, count(*) as n, count(r) as resolved from e group by 1, 2, 3""",
    "remediation_outcomes": f"""with {_F}, {_RES}, r as (select case finding_id % 3 when 1 then 'PROPOSED' else 'APPLIED' end as status,
            case when finding_id % 2 = 0 then result end as result from rs)
        select case when status = 'APPLIED' and result = 'RESOLVED' then 'VERIFIED' when status = 'APPLIED' and result is not null then 'NOT_VERIFIED' else status end as status,
            case when status = 'APPLIED' then coalesce(result, 'NOT_TESTED') end as retest_result, count(*) as n from r group by 1, 2""",
    "regression_history": f"""with {_O} select distinct fingerprint from p where seen_at < timestamp '1995-09-01'
        and fingerprint not in (select fingerprint from p where finding_id % 50 = 0) order by 1 limit 5000""",
    "gate_policies": """select cast(n_nationkey as bigint) as project_id, case when n_nationkey % 4 = 1 then 'own ' || n_name when n_regionkey % 2 = 0 then 'of ' || r_name
        else 'default' end as policy from nation join region on r_regionkey = n_regionkey""",
    "bandit_findings": f"""with x as (select *, p_partkey % 100 + 70 as cwe_number, case p_partkey % 8 when 0 then 'command_injection' when 1 then 'command_injection' when 3 then 'command_injection'
                when 4 then 'command_injection' when 7 then 'sql_injection' end as by_test from part),
        c as (select *, coalesce(by_test, {_CLASS_SQL.format("cwe_number")}, 'dangerous_api') as vuln_class from x)
        select p_partkey as report_id, 'bandit:B' || (p_partkey % 8 + 601) as rule_id, vuln_class,
            case p_partkey % 4 when 0 then 'HIGH' when 2 then 'LOW' else 'MEDIUM' end as severity, case p_partkey % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as confidence,
            'src/' || p_name || '.py' as path, p_size as line, cast(p_partkey % 9 + 1 as integer) as col, p_type as snippet, 'found token = "ghp_************e5F6" in ' || p_brand as message,
            case when {_FIRST_SQL.format("vuln_class")} = 'CWE-' || cwe_number then 'CWE-' || cwe_number else 'CWE-' || cwe_number || ',' || {_FIRST_SQL.format("vuln_class")} end as cwe
        from c""",
    "semgrep_findings": f"""with x as (select *, p_partkey % 100 + 70 as cwe_number from part), c as (select *, coalesce({_CLASS_SQL.format("cwe_number")}, 'dangerous_api') as vuln_class from x)
        select p_partkey as report_id, 'semgrep:a.b.no-' || lower(p_brand) as rule_id, vuln_class, 'no ' || lower(p_brand) as title,
            case p_partkey % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as severity, 'LOW' as confidence, 'src/x.py' as path, p_size as line, 'y = "sk_l************sT1v"' as snippet,
            case when {_FIRST_SQL.format("vuln_class")} = 'CWE-' || cwe_number then 'CWE-' || cwe_number else 'CWE-' || cwe_number || ',' || {_FIRST_SQL.format("vuln_class")} end as cwe
        from c""",
    "gitleaks_findings": """select p_partkey as report_id, 'gitleaks:' || p_type as rule_id,
        'Hardcoded secret (' || case when p_partkey % 2 = 0 then p_name else p_type end || ')' as title, p_name as path, p_size as line, 'CWE-798,CWE-259' as cwe from part""",
    "osv_advisories": """select 'ADV-' || s_suppkey as advisory_id, 'my-pkg' as package, s_name as summary,
        case s_suppkey % 3 when 0 then 'MEDIUM' when 1 then 'HIGH' else 'LOW' end as severity, 'CVE-' || s_suppkey as aliases,
        '>=0, <' || s_nationkey || '.1; >=' || s_nationkey || '.2' as affected_ranges, s_nationkey || '.1' as fixed_versions from supplier where s_suppkey % 5 <> 0""",
}
