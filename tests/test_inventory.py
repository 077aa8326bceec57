import hashlib
import json

from pyspark.sql import functions as F

from findinglake.operators import sarif
from findinglake.sources import inventory as I


def test_inventory(spark, tmp_path):
    files = {
        "a.py": b"x = 1\ny", "s/run": b"#!/usr/bin/env python3\n", "p.inc": b"\n<?php 1", "node_modules/x/a.js": b"1", "b.min.js": b"1", "img.PNG": b"x",
        "nul.txt": b"a\x00b", "ctl.c": b"\x01\x02abc", "big.go": b"x" * 200, "empty.rs": b"", ".bashrc": b"a\n", "q/build/z": b"1",
    }
    for name, data in files.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    (tmp_path / "tree" / "link.py").symlink_to(tmp_path / "tree" / "a.py")
    got = {r.path: r for r in I.inventory(I.read_tree(spark, str(tmp_path / "tree"), slices=3), max_bytes=100).collect()}
    want = {
        "a.py": ("ANALYZED", "python", 2), "s/run": ("ANALYZED", "python", 1), "p.inc": ("ANALYZED", "php", 2), "node_modules/x/a.js": ("EXCLUDED", "javascript", None),
        "b.min.js": ("EXCLUDED", "javascript", None), "img.PNG": ("SKIPPED_BINARY", None, None), "nul.txt": ("SKIPPED_BINARY", None, None),
        "ctl.c": ("SKIPPED_BINARY", "c", None), "big.go": ("SKIPPED_SIZE", "go", None), "empty.rs": ("ANALYZED", "rust", 0), ".bashrc": ("ANALYZED", None, 1),
        "q/build/z": ("EXCLUDED", None, None),
    }
    assert {k: (r.status, r.language, r.lines) for k, r in got.items()} == want
    assert got["a.py"].sha256 == hashlib.sha256(files["a.py"]).hexdigest()


def test_deep_tree_with_one_top_folder(spark, tmp_path):
    want = set()
    for i in range(4):
        for j in range(6):
            name = f"top/a/b{i}/c/.d{j}/f{i}{j}.txt"
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text("x" * j)
            want.add((name, j))
    (tmp_path / "top" / "loop").symlink_to(tmp_path / "top")
    (tmp_path / "empty").mkdir()
    assert {(r.path, r.size) for r in I.tree_names(spark, str(tmp_path)).collect()} == want
    assert I.tree_names(spark, str(tmp_path / "empty")).count() == 0


def test_excludes_and_archives(spark):
    paths = spark.createDataFrame([("lib/gen/a.py",), ("lib/gen2/a.py",), ("x/lib/gen/a",), ("a.tmp",), ("d/a.tmp",)], "path string")
    got = {r.path for r in paths.where(I.excluded(F.col("path"), ["lib/gen/", "*.tmp"])).collect()}
    assert got == {"lib/gen/a.py", "a.tmp", "d/a.tmp"}
    entries = spark.createDataFrame([("a", "top/x"), ("a", "top/y/z"), ("b", "top/x"), ("b", "y")], "archive string, path string")
    assert {(r.archive, r.name) for r in I.archive_paths(entries).collect()} == {("a", "x"), ("a", "y/z"), ("b", "top/x"), ("b", "y")}


def test_sarif(spark):
    schema = "ord int, rule_id string, vuln_class string, severity string, title string, cwe array<string>, fingerprint string, path string, line int, steps array<struct<path:string,line:int,note:string>>"
    rows = [(1, "r2", "sql_injection", "HIGH", "T|1", ["CWE-89"], "f1", "a.py", 3, [("a.py", 1, ""), ("a.py", 3, "n"), (None, 1, "x")]), (2, "r1", "xss", "LOW", "T2", None, "f2", None, None, None), (3, "r2", "sql_injection", "HIGH", "T3", [], "f3", "b.py", None, [])]
    df = spark.createDataFrame(rows, schema)
    rules = {r.rule_id: (r.rule_index, json.loads(r.rule)) for r in sarif.rules(df).collect()}
    assert rules["r2"][0] == 0 and rules["r1"][0] == 1 and rules["r2"][1]["name"] == "SqlInjection" and rules["r2"][1]["properties"]["tags"] == ["security", "CWE-89"]
    res = {r.ord: json.loads(r.result) for r in sarif.results(df).collect()}
    assert len(res[1]["codeFlows"][0]["threadFlows"][0]["locations"]) == 2 and res[1]["ruleIndex"] == 0 and res[1]["level"] == "error"
    assert "locations" not in res[2] and "codeFlows" not in res[3] and "region" not in res[3]["locations"][0]["physicalLocation"]
    assert sarif.markdown_rows(df).orderBy("ord").first().row == r"| HIGH | T\|1 | a.py | 3 |"
