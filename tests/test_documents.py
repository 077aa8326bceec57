import json
import os

import pytest
from pyspark.sql import functions as F

from findinglake.operators import documents, reports, sarif
from findinglake.sinks.document import section, write_document

TITLE = 'T|1 <b>"x"</b> & é'
FINDINGS = [
    (3, "r2", "sql_injection", "HIGH", TITLE, ["CWE-89"], "src/a b.py", 3, ["https://a", "ftp://x"], "HIGH"), (1, "r1", "xss", "LOW", "T2", None, None, None, None, None),
    (2, "r2", "sql_injection", "CRITICAL", "T3", [], "b.py", None, [], "LOW"), (2, "r0", "ssrf", None, "T4", [], "", 0, [], "LOW"),
]
SCHEMA = "ord int, rule_id string, vuln_class string, severity string, title string, cwe array<string>, path string, line int, references array<string>, confidence string"


def _tables(spark, findings=FINDINGS):
    f = spark.createDataFrame(findings, SCHEMA).withColumns({"source_kind": F.lit("SAST"), "verification": F.lit("DETECTED"), "exploitability": F.lit("POSSIBLE")})
    d = spark.createDataFrame([("npm", "b", "1", "VULNERABLE"), ("npm", "a", None, "NOT_VERIFIED")], "ecosystem string, name string, version string, vuln_status string")
    files = spark.createDataFrame([("ANALYZED", "go", 5), ("ANALYZED", "zig", 2), ("SKIPPED_SIZE", "go", 9)], "status string, language string, lines int")
    scanners = spark.createDataFrame([(1, "sast", "ran", None, 3), (2, "dependency-advisories", "failed", "offline", 0)], "ord int, scanner string, status string, detail string, findings int")
    return f, d, files, scanners


def _about(tables, **more):
    f, d, files, scanners = tables
    return documents.context(f, d, files, scanners, target="shop", supported=("go",), errors=["e"] * 60, told={"gate": {"status": "FAIL"}, "risk": {"index": 7}} | more)


def test_ordered_rows_of_many_tasks(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).repartition(7).select((F.col("id") % 2).cast("int").alias("section"), F.when(F.col("id") != 4, F.to_json(F.struct("id"))).otherwise("null").alias("text"), "id")
    path = write_document(rows, f"{tmp_path}/out/doc.json", [section('{"even":['), section('],"odd":[', close="]}")], ["id"])
    whole = json.load(open(path))
    assert [x and x["id"] for x in whole["even"]] == [None if i == 4 else i for i in range(0, n, 2)] and [x["id"] for x in whole["odd"]] == list(range(1, n, 2))
    assert os.listdir(f"{tmp_path}/out") == ["doc.json"]
    write_document(rows.limit(0), path, [section("["), section(close="]")], ["id"])
    assert open(path).read() == "[]"
    with pytest.raises(Exception, match="doc.json"):
        write_document(rows, path, [section(), section()], ["id"], overwrite=False)


def test_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(100).select(F.lit(0).alias("section"), F.when(F.col("id") == 70, F.raise_error(F.lit("no"))).otherwise("x").alias("text"), "id")
    with pytest.raises(Exception, match="no"):
        write_document(rows, f"{tmp_path}/doc", [section()], ["id"])
    assert not os.path.exists(f"{tmp_path}/doc")


def test_json_report(spark, tmp_path):
    tables = _tables(spark)
    about = _about(tables)
    whole = json.load(open(documents.write_json(*tables[:2], f"{tmp_path}/r.json", about)))
    assert [x["title"] for x in whole["findings"]] == ["T2", "T3", "T4", TITLE] or [x["title"] for x in whole["findings"]] == ["T2", "T4", "T3", TITLE]
    last = whole["findings"][-1]
    assert last["location"] == {"path": "src/a b.py", "start_line": 3} and last["references"] == ["https://a"] and last["steps"][-1]["number"] == 2
    assert [d["name"] for d in whole["dependencies"]] == ["a", "b"] and whole["gate"] == {"status": "FAIL"} and len(whole["errors"]) == 50
    s = whole["report"]["summary"]
    assert s["total"] == 4 and s["by_severity"] == {"CRITICAL": 1, "HIGH": 1, "MEDIUM": 0, "LOW": 1, "INFO": 0} and s["dependencies"] == {"NOT_VERIFIED": 1, "VULNERABLE": 1}
    scope = whole["report"]["scope"]
    assert scope["languages"] == [{"name": "go", "files": 1, "lines": 5, "sast": True}, {"name": "zig", "files": 1, "lines": 2, "sast": False}]
    assert scope["dependencies_total"] == 2 and scope["scope"] == "FULL" and scope["scanners"][1]["detail"] == "offline"
    assert len(whole["report"]["methodology"]) == 3 and any("zig" in x for x in whole["report"]["limitations"]) and any(x.startswith("60 error") for x in whole["report"]["limitations"])
    back = reports.imported(reports.read_saved(spark, f"file://{tmp_path}/r.json"))
    assert {(r.target, r.rule_id, r.path) for r in back.collect()} == {("shop", r[1], r[6]) for r in FINDINGS}


def test_sarif_log(spark, tmp_path):
    f = _tables(spark)[0].withColumns({"summary": F.lit("s"), "owasp": F.array(F.lit("A03:2021 Injection")), "source": F.struct(F.lit("a.py").alias("path"), F.lit(1).alias("line"), F.lit("c").alias("code"), F.lit("l").alias("label"))})
    f = f.withColumn("steps", F.array(F.struct(F.lit("b.py").alias("path"), F.lit(2).alias("line"), F.lit("").alias("note"))))
    log = json.load(open(sarif.write_sarif(f, f"{tmp_path}/x.sarif", "shop", started_at="now", errors=["e"], skipped=["bandit skipped: x"], gate={"status": "PASS"})))
    run = log["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert log["version"] == "2.1.0" and [r["id"] for r in rules] == ["r1", "r0", "r2"] and rules[2]["name"] == "SqlInjection" and rules[2]["defaultConfiguration"]["level"] == "error"
    assert rules[2]["properties"]["security-severity"] == "9.5" and rules[2]["properties"]["problem.severity"] == "error" and "A03:2021" in rules[2]["properties"]["tags"]
    assert all(r["ruleIndex"] == [x["id"] for x in rules].index(r["ruleId"]) for r in run["results"]) and len(run["results"]) == 4
    last = run["results"][-1]
    assert last["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "src/a%20b.py" and last["message"]["text"] == TITLE + ". s"
    assert [x["location"]["message"]["text"] for x in last["codeFlows"][0]["threadFlows"][0]["locations"]] == ["Source: l", "data flows here"]
    assert run["properties"] == {"gate": {"status": "PASS"}, "riskIndex": None} and len(run["invocations"][0]["toolExecutionNotifications"]) == 2
    empty = json.load(open(sarif.write_sarif(f.limit(0), f"{tmp_path}/e.sarif", "shop")))
    assert empty["runs"][0]["results"] == [] == empty["runs"][0]["tool"]["driver"]["rules"]


def test_html_and_markdown(spark, tmp_path):
    tables = _tables(spark)
    about = _about(tables, title="<R>")
    page = open(documents.write_html(*tables[:2], f"{tmp_path}/r.html", about)).read()
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</body></html>\n") and page.count("<article") == 4 and page.count("<tr><td>npm") == 2
    assert "&lt;b&gt;&#34;x&#34;&lt;/b&gt; &amp; é" in page and "<title>&lt;R&gt;</title>" in page and "ftp://x" not in page and "<b>" not in page
    text = open(documents.write_markdown(tables[0], f"{tmp_path}/r.md", about, most=2)).read()
    assert text.startswith("# <R>") and "Gate: **FAIL**" in text and "2 more findings" in text and text.count("\n| ") == 3
    assert json.dumps(about)
