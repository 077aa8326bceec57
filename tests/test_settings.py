import json

from findinglake.operators import detail, settings


def _problems(spark, texts, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "config_id int, content string")
    out = {}
    for r in settings.problems(df, rules).orderBy("config_id", "place").collect():
        out.setdefault(r.config_id, []).append((r.path, r.message))
    return out


def test_configuration(spark):
    texts = [
        None, "", "{}", "null", "[]", '{"version": 1, "gate": {"fail_on": ["high"], "max_findings": null, "min_confidence": "low"}, "scan": {"external": false}}',
        "{", "[1]", '{"gate": {"fail_on": [], "fail_on": []}}', '{"gate": {"fial_on": []}}', '{"gate": []}', '{"other": 1}',
        '{"scan": {"scanners": ["sast", "x", 3], "max_file_kb": 0, "exclude": "a", "external": 1}}',
        '{"version": 2, "gate": {"max_findings": 1.5, "include_ai_suggested": "maybe", "min_confidence": null}}',
        json.dumps({"report": {"directory": "x" * settings.LONGEST}}), json.dumps({f"k{i:02}": 1 for i in range(30)}),
    ]
    got = _problems(spark, texts, settings.CONFIGURATION)
    assert set(got) == set(range(6, 16))
    assert got[6] == [("", "isn't JSON")] == got[8] and got[7] == [("", "must be an object")]
    assert got[9] == [("gate.fial_on", "isn't a known key")] and got[10] == [("gate", "must be an object")] and got[11] == [("other", "isn't a known key")]
    assert [p for p, _ in got[12]] == ["scan.exclude", "scan.external", "scan.max_file_kb", "scan.scanners.1", "scan.scanners.2"]
    assert [p for p, _ in got[13]] == ["gate.include_ai_suggested", "gate.max_findings", "gate.min_confidence", "version"]
    assert got[14] == [("", "is longer than 256 KB")] and [p for p, _ in got[15]] == [f"k{i:02}" for i in range(10)]


def test_policies_and_weights(spark):
    df = spark.createDataFrame(
        [(1, '{"gate": {"fail_on": ["low", "info"], "include_ai_suggested": "yes", "max_findings": 3}}', 0), (2, None, 0), (3, '{"gate": 1}', 0)],
        "config_id int, content string, v int",
    )
    got = {r.config_id: tuple(r)[1:] for r in settings.gate_policies(df).collect()}
    assert got == {1: (["LOW", "INFO"], "MEDIUM", True, True, 3), 2: (["CRITICAL", "HIGH"], "MEDIUM", False, True, None)}
    texts = ['{"severity": {"HIGH": 2}, "saturation": 50}', '{"severity": {"HIGH": true}}', '{"severity": {"HUGE": 1}, "saturation": 0, "other": {}}',
             '{"status": 3, "exposure": {"INTERNAL": "1", "UNKNOWN": 100.5}}', None]
    found = _problems(spark, texts, settings.RISK_WEIGHTS)
    assert {k: [p for p, _ in v] for k, v in found.items()} == {
        1: ["severity.HIGH"], 2: ["other", "saturation", "severity.HUGE"], 3: ["exposure.INTERNAL", "exposure.UNKNOWN", "status"],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "config_id int, content string")
    weights = {r.config_id: r.weights for r in settings.risk_weights(df).collect()}
    assert set(weights) == {0, 4} and weights[0]["severity.HIGH"] == 2 and weights[0]["saturation"] == 50 and weights[4]["severity.HIGH"] == 7


def test_gate_and_risk(spark):
    cols = "g int, severity string, confidence string, exploitability string, verification string, status string"
    f = spark.createDataFrame(
        [(1, "HIGH", "HIGH", "LIKELY", "DETECTED", "OPEN")] * 3 + [(1, "LOW", "HIGH", "LIKELY", "DETECTED", "OPEN"), (2, "LOW", "LOW", "LIKELY", "DETECTED", "OPEN"),
         (2, "HIGH", "HIGH", "LIKELY", "AI_SUGGESTED", "OPEN"), (3, None, None, None, None, None), (4, "HIGH", "HIGH", "LIKELY", "DETECTED", "RESOLVED")], cols)
    docs = spark.createDataFrame([(1, '{"gate": {"max_findings": 2}}'), (4, '{"gate": {"fail_on_regression": false}}')], "g int, content string")
    over = spark.createDataFrame([(1, '{"severity": {"HIGH": 1}, "saturation": 10}')], "g int, content string")
    back = spark.createDataFrame([(2, 1), (4, 2)], "g int, n int")
    out = settings.gate_and_risk(f, "g", settings.gate_policies(docs, "g"), settings.risk_weights(over, "g"), back)
    got = {r.g: r for r in out.collect()}
    assert got[1].reasons == ["3 HIGH from confidence MEDIUM", "4 open, allowed 2"] and got[1].total_risk == 3.443 and got[1].risk_index == 29.1
    assert got[2].gate == "FAIL" and got[2].blocking == 0 and got[2].reasons == ["1 came back after they were resolved"]
    assert (got[3].gate, got[3].counted, got[3].risk_index) == ("PASS", 0, 0.0) and got[4].gate == "PASS"
    assert settings.gate_and_risk(f.limit(0), "g", settings.gate_policies(docs, "g"), settings.risk_weights(over, "g"), back).count() == 0


def test_details(spark):
    o = spark.range(10_000).selectExpr("1L as finding_id", "if(id = 5, null, timestamp_seconds(id)) as seen_at", "'p' as path", "cast(id as int) as line", "'s' as scanner", "null as snippet")
    o = o.unionByName(o.limit(1).selectExpr("cast(null as long) as finding_id", "seen_at", "path", "line", "scanner", "snippet"))
    r = spark.createDataFrame([(2, None, 7, "NEW"), (2, None, 6, "NEW"), (9, None, 1, "NEW")], "finding_id long, created_at timestamp, retest_id long, result string")
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "finding_id long, title string")
    df = detail.finding_details(f, o, r, tested=1)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    got = {x.finding_id: x for x in df.collect()}
    assert [x.line for x in got[1].occurrences] == list(range(9999, 9979, -1)) and got[1].retests == []
    assert [x.retest_id for x in got[2].retests] == [6] and got[3].occurrences == [] and len(got) == 3


def test_snapshots_and_baselines(spark):
    cols = "fingerprint string, severity string, confidence string, rule_id string, path string, line int, snippet string"
    old = spark.createDataFrame([("a", "HIGH", "LOW", "r", "p", 3, None), ("a", "LOW", "LOW", "r", "p", 9, None), ("b", None, None, "r", None, None, None), (None, "LOW", "LOW", "r", "p", 1, None)], cols)
    new = spark.createDataFrame([("a", "HIGH", "HIGH", "r", "p", 4, None), ("c", "LOW", None, "r", "p", 1, "x")], cols)
    got = {r.fingerprint: r for r in detail.snapshot_changes(old, new).collect()}
    assert got["a"].changed == ["confidence", "line"] and got["a"].before.line == 3
    assert got["b"].changed == ["rule_id"] and got["b"].after is None and got["c"].changed == ["severity", "rule_id", "path", "line", "snippet"]
    assert detail.snapshot_changes(old, old).where("size(changed) > 0").count() == 0 and len(got) == 3
    f = spark.createDataFrame([(1, "a", "q"), (2, "b", None)], "finding_id int, fingerprint string, path string")
    f = f.selectExpr("*", "'r' as rule_id", "'SAST' as engine", "'c' as vuln_class", "'t' as title", "'LOW' as severity", "'LOW' as confidence")
    o = spark.createDataFrame([(10, 1, None), (10, 2, None), (11, 1, "z")], "scan_id int, finding_id int, path string")
    o = o.selectExpr("*", "1 as line", "1 as end_line", "'f' as function", "'s' as snippet", "cast(null as array<string>) as scanners")
    scans = spark.createDataFrame([(12, 10), (13, 10), (14, None)], "scan_id int, baseline_scan_id int")
    rows = sorted((r.for_scan, r.fingerprint, r.path, r.scanners) for r in detail.baseline_rows(f, o, scans).collect())
    assert rows == [(12, "a", "q", []), (12, "b", "", []), (13, "a", "q", []), (13, "b", "", [])]
    d = spark.createDataFrame([(1, "npm", "x", None, "m", 2), (1, "npm", "x", None, "m", 1), (1, "npm", "x", "1", "m", 3)], "scan_id int, ecosystem string, name string, version string, manifest_path string, ord int")
    assert sorted(r.ord for r in detail.one_of_each_dependency(d, ["ord"]).collect()) == [1, 3]
