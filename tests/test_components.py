from pyspark.sql import functions as F

from findinglake.operators import merge
from findinglake.operators.components import grouped_by_keys, smallest_linked


def test_long_chain_in_few_rounds(spark):
    """A chain of 10,000 aliases, its ids in no order."""
    n = 10_000
    mixed = lambda c: (c * 7919) % n  # noqa: E731  (a permutation, as 7919 is prime to n)
    links = spark.range(n - 1).select(mixed(F.col("id")).alias("node"), mixed(F.col("id") + 1).alias("to"))
    found, rounds = smallest_linked(links)
    assert rounds < 15
    assert found.count() == n - 1 and found.where("to <> 0").count() == 0
    straight, rounds = smallest_linked(spark.range(n - 1).select(F.col("id").alias("node"), (F.col("id") + 1).alias("to")))
    assert rounds < 15 and straight.where("to <> 0").count() == 0


def test_groups_by_keys(spark):
    rows = [(5, ["a", "b"]), (3, ["b", None]), (9, ["c"]), (9, ["d"]), (1, ["d"]), (7, []), (8, None), (4, ["hot"]), (6, ["hot"]), (2, ["hot", "c"])]
    got = {r.id: r.group_id for r in grouped_by_keys(spark.createDataFrame(rows, "id long, keys array<string>")).collect()}
    assert got == {5: 3, 3: 3, 9: 1, 1: 1, 7: 7, 8: 8, 4: 1, 6: 1, 2: 1}
    assert grouped_by_keys(spark.createDataFrame([], "id long, keys array<string>")).count() == 0


SCHEMA = (
    "id long, source_kind string, vuln_class string, base_class string, path string, line int, scanners array<string>, rule_id string, ecosystem string, package_name string, "
    "version string, advisory_id string, aliases array<string>, severity string, confidence string, exploitability string, title string, has_flow boolean, ai boolean, own boolean, "
    f"cwe array<string>, references array<string>, tags array<string>, evidence {merge.EVIDENCE}"
)


def _report(id_, kind, cls, path, line, scanner, **more):
    row = dict.fromkeys(c.split(" ")[0] for c in SCHEMA.split(", "))
    row |= {"id": id_, "source_kind": kind, "vuln_class": cls, "path": path, "line": line, "scanners": [scanner], "rule_id": f"r{id_}", "severity": "LOW", "confidence": "LOW"}
    return tuple((row | {"exploitability": "LIKELY", "title": f"t{id_}"} | more).values())


def test_all_branches(spark):
    pkg = {"ecosystem": "npm", "package_name": "P", "version": "1"}
    rows = [
        _report(1, "SAST", "xss", "a", 10, "s", severity="HIGH", cwe=["CWE-1"], evidence=[("k", "s", "x", 1)], references=["u"]),
        _report(2, "SAST", "other", "a", 12, "t:1", base_class="xss", cwe=["CWE-2", "CWE-1"], evidence=[("k", "s", "x", 1), ("k", "s", "y", None)], confidence="MEDIUM"),
        _report(3, "SAST", "xss", "a", 11, "s"), _report(4, "SAST", "xss", "a", None, "s"), _report(5, "LLM_TEST", "xss", "a", 10, "t"),
        _report(6, "SECRET", "x", "a", 10, "s"), _report(7, "SAST", "hardcoded_secret", "a", 10, "u"), _report(8, "SECRET", "x", None, None, "s"), _report(9, "SECRET", "x", None, None, "t"),
        _report(10, "DEPENDENCY", "v", "m", 1, "d", advisory_id="A", aliases=["C"], **pkg), _report(11, "DEPENDENCY", "v", "m", 1, "e", advisory_id="B", **pkg),
        _report(12, "DEPENDENCY", "v", "m", 1, "e", advisory_id="C", aliases=["B", ""], **pkg), _report(13, "DEPENDENCY", "v", "m", 1, "e", advisory_id="C", **(pkg | {"version": "2"})),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.group_id for r in merge.correlated(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 10, 12: 10, 13: 13}
    found = {r.group_id: r for r in merge.correlated_findings(df.withColumn("ord", F.col("id"))).collect()}
    one = found[1]
    assert (one.merged, one.confidence, one.severity, one.rule_id, one.raised) == (2, "HIGH", "LOW", "r2", True)  # only r2's confidence is trusted
    assert one.scanners == ["t:1", "s"] and one.cwe == ["CWE-2", "CWE-1"] and one.references == ["u"] and one.tags == []
    assert [tuple(e) for e in one.evidence] == [("k", "s", "x", 1), ("k", "s", "y", None)]
    assert one.reason == "2 reports of other at a:12 by t:1, s. The scanners agree: confidence one level up."
    assert found[3].reason is None and found[10].merged == 3 and found[10].scanners == ["d", "e"] and len(found) == 8
