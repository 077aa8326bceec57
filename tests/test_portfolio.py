"""New operators on nulls, ties, repeated rows, empty tables and clashing names."""

import hashlib
import hmac

from pyspark.sql import functions as F

from findinglake.functions import columns as C
from findinglake.operators import access, dashboard, identity, lifecycle, merge
from findinglake.operators.numbering import last_before, numbered
from findinglake.sources import adapters


def test_numbered_over_blocks(spark):
    rows = [(p, s, i) for p in ("a", "b", None) for i, s in enumerate([2, 1, None, 2, 1, 1])] + [("a", 1, 4), ("a", 1, None)]
    df = spark.createDataFrame(rows, "p string, s int, id long")
    got = numbered(df, "p", {"s": F.col("s")}, "id", width=2).collect()
    assert len(got) == len(rows)
    for p in ("a", "b", None):
        own = sorted((r for r in got if r.p == p), key=lambda r: r.nth)
        assert [r.nth for r in own] == list(range(1, len(own) + 1))
        keys = [(r.s is not None, r.s or 0, r.id is not None, r.id or 0) for r in own]
        assert keys == sorted(keys)
    assert numbered(df.limit(0), "p", {}, "id").count() == 0


def test_last_before_crosses_days(spark):
    rows = [(1, f"2024-01-0{d} 0{h}:00:00", i, v) for i, (d, h, v) in enumerate([(1, 1, 5), (1, 2, None), (2, 1, None), (2, 2, 7), (4, 1, None), (4, 1, 9)])]
    rows.append((2, None, 8, 3))
    df = spark.createDataFrame(rows, "p int, t string, id int, v int").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.id: r.before for r in last_before(df, "p", "t", "id", F.col("v"), "before").collect()}
    assert got == {0: None, 1: 5, 2: 5, 3: 5, 4: 7, 5: 7, 8: None}


def test_keyed_hash_is_hmac(spark):
    values = ["", "a", "naïve café", "x" * 300, None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for key in (b"k", b"long" * 40):
        got = {r.v: r.h for r in df.select("v", identity.keyed_hash(F.col("v"), key).alias("h")).collect()}
        assert got == {v: None if v is None else hmac.new(key, v.encode(), hashlib.sha256).hexdigest() for v in values}


_REPORT = (
    "group_id int, ord int, rule_id string, title string, vuln_class string, path string, line int, has_flow boolean, ai boolean, own boolean, "
    "severity string, confidence string, exploitability string, scanners array<string>, cwe array<string>"
)


def test_merge_groups(spark):
    rows = [
        (1, 1, "r1", "t", "xss", "a", 1, False, False, False, "CRITICAL", "LOW", "POSSIBLE", ["bandit"], ["CWE-1", None, "CWE-2"]),
        (1, 2, "r2", "t", "xss", "a", 2, None, False, True, "HIGH", "MEDIUM", "LIKELY", ["own:sast"], ["CWE-2", "CWE-3"]),
        (2, 3, "r3", "t", "xss", "a", 9, False, False, False, "LOW", "LOW", "LIKELY", ["x:a"], None),
        (3, 4, "r4", "t", "xss", None, None, False, False, False, "LOW", "LOW", "LIKELY", ["x:a"], []),
        (3, 5, "r5", "t", "xss", None, None, False, False, False, "HIGH", "LOW", "LIKELY", ["x:b"], []),
    ]
    df = spark.createDataFrame(rows, _REPORT)
    got = {r.group_id: r for r in merge.merge_groups(df).collect()}
    one = got[1]
    assert (one.rule_id, one.merged, one.severity, one.confidence, one.exploitability, one.raised) == ("r2", 2, "HIGH", "HIGH", "LIKELY", True)
    assert one.scanners == ["own:sast", "bandit"] and one.cwe == ["CWE-2", "CWE-3", "CWE-1"]
    assert (got[2].confidence, got[2].raised, got[2].cwe) == ("LOW", False, [])
    assert (got[3].severity, got[3].raised, got[3].scanners) == ("HIGH", False, ["x:b", "x:a"])  # one scanner, two rules; the worse one is first
    assert merge.merge_groups(df.limit(0)).count() == 0


def test_alias_keys(spark):
    schema = "ecosystem string, package_name string, version string, advisory_id string, rule_id string, aliases array<string>"
    df = spark.createDataFrame([("npm", "A", "1", "G", "r", ["C", "G", None, ""]), ("npm", "A", None, None, "r", None)], schema)
    assert [r[0] for r in df.select(merge.alias_keys()).collect()] == [["npm|a|1|G", "npm|a|1|C"], ["npm|a||r"]]


def test_access_rules(spark):
    df = spark.createDataFrame([("OWNER", "ADMIN"), ("ADMIN", "ADMIN"), ("ADMIN", "VIEWER"), ("VIEWER", "VIEWER"), (None, "VIEWER"), ("ADMIN", "?")], "a string, t string")
    assert [r[0] for r in df.select(access.may_assign(F.col("a"), F.col("t"))).collect()] == [True, False, True, False, False, False]
    urls = {
        "https://GitHub.com/a/b.git": "https://github.com/a/b.git", "https://github.com:443/a/b/": "https://github.com/a/b", "http://github.com/a/b": None,
        "https://u@github.com/a/b": None, "https://github.com/a": None, "https://github.com/a/b?x": None, "https://evil.com/a/b": None, None: None,
        "https://github.com:8443/a/b": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.g for r in df.select("u", access.git_url(F.col("u"), ["github.com"]).alias("g")).collect()} == urls
    names = {"main": True, "-x": False, "a..b": False, "a//b": False, "a/": False, "a.lock": False, "feature/x-1": True, "a b": False}
    df = spark.createDataFrame([(u,) for u in names], "u string")
    assert {r.u: r.g for r in df.select("u", access.branch_ok(F.col("u")).alias("g")).collect()} == names
    df = spark.createDataFrame([(1, 9, None, "git"), (2, 9, 4, "git"), (3, 8, None, "git")], "integration_id int, organization_id int, project_id int, kind string")
    projects = spark.createDataFrame([(4, 9), (5, 9), (6, 7)], "project_id int, organization_id int")
    got = {(r.project_id, r.integration_id, r.organization_wide) for r in access.integration_for(projects, df, "git").collect()}
    assert got == {(4, 2, False), (5, 1, True)}


def test_texts_of_reports(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one(C.strip_controls, "a\tb\nc\x1b[0m‮d") == "a\tb\nc[0md" and one(C.strip_controls, None) == ""
    assert one(C.markdown_escape, "a|b*c\nd") == r"a\|b\*c d" and one(C.markdown_escape, "# x") == "\\# x" and one(C.markdown_escape, "1. x") == "\\1. x"
    assert one(C.markdown_code, "a`b``c") == "```a`b``c```" and one(C.markdown_code, "`a") == "`` `a ``" and one(C.markdown_code, None) == ""
    assert one(lambda c: C.markdown_code(c, True), "a|b") == r"`a\|b`"
    assert one(C.human_label, "IN_PROGRESS") == "In progress" and one(C.human_label, "AI_SUGGESTED") == "AI-suggested" and one(C.human_label, None) == "—"
    assert one(C.file_slug, "My report: v1.0/x") == "My-report-v1.0-x" and one(C.slugify, " My  Project! ") == "my-project"
    bands = [r[0] for r in spark.range(0, 100, 25).select(C.risk_band(F.col("id"))).collect()]
    assert bands == ["low", "medium", "high", "critical"]


def test_adapters_on_odd_reports(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, "{}"), (4, '{"results": []}')], "report_id int, json string")
    assert adapters.bandit(df).count() == adapters.semgrep(df).count() == adapters.gitleaks(df).count() == 0
    one = '{"results": [{"test_id": "B999", "code": null, "line_number": 3}]}'
    row = adapters.bandit(spark.createDataFrame([(1, one)], "report_id int, json string")).first()
    assert (row.rule_id, row.vuln_class, row.severity, row.title, row.line, row.col) == ("bandit:B999", "dangerous_api", "MEDIUM", "B999 (Bandit B999)", 3, 1)
    assert adapters.osv_records(df.select("json")).count() == 0


def test_advisory_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text('[{"id": "A"}, {"id": "B", "withdrawn": "2020"}]')
    (tmp_path / "b.json").write_text('{"id": "C", "affected": [{"package": {"ecosystem": "npm", "name": "x"}}]}')
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "other.txt").write_text('{"id": "D"}')
    assert sorted(r.record.id for r in adapters.osv_files(spark, str(tmp_path)).collect()) == ["A", "C"]


def test_changes_need_no_findings(spark):
    f = spark.createDataFrame([], "finding_id long, status string, verification string, resolved_at timestamp")
    r = spark.createDataFrame([(1, "OPEN", "CONFIRMED", "OWNER", None, None)], "finding_id long, new_status string, new_verification string, role string, reason string, at timestamp")
    assert lifecycle.change_status(f, r).count() == lifecycle.change_verification(f, r).count() == 0
    empty = spark.createDataFrame([], "project_id int, fingerprint string, number long")
    new = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (1, "b", 4)], "project_id int, fingerprint string, ord long")
    assert {(x.fingerprint, x.number) for x in lifecycle.persistent_numbers(empty, new).collect()} == {("a", 1), ("b", 2)}


def test_dashboard_without_rows(spark):
    f = spark.createDataFrame([], "finding_id long, project_id int, severity string, status string, verification string, risk_score double")
    s = spark.createDataFrame([], "scan_id long, project_id int, repository_id long, status string, finished_at timestamp, risk_index double")
    p = spark.createDataFrame([(1, "b"), (2, "a")], "project_id int, name string")
    assert [(r.name, r.open, r.risk_index) for r in dashboard.projects_with_latest(p, s, f).collect()] == [("a", 0, None), ("b", 0, None)]
    assert dashboard.top_by_risk(f).count() == dashboard.recent_scans(s, s.select("repository_id", F.lit("x").alias("name"))).count() == 0
    assert {(r.value, r.n) for r in dashboard.summary(f, {"x": ("severity", True)}).collect()} == {(v, 0) for v in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")}
