import json

from findinglake.operators import classes


def test_catalogue(spark):
    entries = [
        {"key": "xss", "name": "XSS", "cwe": ["CWE-79"], "severity": "HIGH", "description": " a\n  b\t", "remediation": "Escape.", "examples": {"php": {"vulnerable": "p", "secure": "q"}, "javascript": {"vulnerable": "j", "secure": "k"}}},
        {"key": "ai", "name": "AI", "engine": "AISEC", "severity": "HUGE", "remediation": "Ask.", "references": ["https://a"]},
        {"key": "bare", "name": "B"}, {"name": "no key"}, {"key": "nameless"},
    ]
    texts = spark.createDataFrame([(json.dumps(e),) for e in entries] + [("{",), (None,), (json.dumps(entries[2]),)], "json string")
    known = classes.catalog(texts)
    rows = {r.key: r for r in known.collect()}
    assert set(rows) == {"xss", "ai", "bare"} and rows["xss"].description == "a b" and rows["ai"].severity == "MEDIUM" and rows["ai"].category == "AI Security" and rows["bare"].cwe == []
    f = spark.createDataFrame([(1, "xss", "tsx", "x"), (2, "xss", "go", "x"), (3, "xss", None, "x"), (4, "ai", "go", "x"), (5, "none", "go", "x"), (6, None, None, "x"), (7, "bare", "go", "x")], "id int, vuln_class string, language string, impact string")
    got = {r.id: r for r in classes.described(f, known).collect()}
    assert [got[i].example and got[i].example.language for i in range(1, 8)] == ["javascript", "php", "php", None, None, None, None]
    assert got[1].secure_pattern == "Escape.\n\nInstead of:\n    j\n\nwrite:\n    k" and got[4].secure_pattern == "Ask." and got[5].class_name is None and got[7].secure_pattern == ""
    assert got[2].root_cause == "a b" and got[5].impact is None and len(got) == 7
    assert classes.described(f.limit(0), known).count() == 0 and classes.catalog(texts.limit(0)).count() == 0
