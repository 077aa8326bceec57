from functools import cmp_to_key
from itertools import product

import pytest
from pyspark.sql import functions as F

from findinglake.operators import versions as V

PEP = ["1.0", "1.0.0", "1.0a1", "1.0.dev3", "1.0rc2", "1.0.post1", "1.0-2", "1!0.5", "1.0+local.2", "1.0+local.10", "1.0a1.dev2", "0.9", "1.10", "v1.0b", "1.0.post1.dev4"]
SEM = ["1.2.3", "1.2.3-alpha", "1.2.3-alpha.1", "1.2.3-alpha.beta", "1.2.3-2", "1.2.3+build", "v2", "junk", "1.10.0", "1.9.9", "1.2.3.4", "V1"]


def test_pep440_order(spark):
    packaging = pytest.importorskip("packaging.version")
    rows = list(product(PEP, PEP))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", V.compare_versions(F.lit("PyPI"), F.col("a"), F.col("b")).alias("c")).collect()
    for r in got:
        a, b = packaging.Version(r.a), packaging.Version(r.b)
        assert r.c == (a > b) - (a < b), r


def test_release_order(spark):
    rows = spark.createDataFrame(list(product(SEM, SEM)), "a string, b string")
    order = {(r.a, r.b): r.c for r in rows.select("a", "b", V.compare_versions(F.lit("npm"), F.col("a"), F.col("b")).alias("c")).collect()}
    ranked = sorted(SEM, key=cmp_to_key(lambda a, b: order[a, b]))
    assert ranked.index("1.2.3-2") < ranked.index("1.2.3-alpha") < ranked.index("1.2.3-alpha.1") < ranked.index("1.2.3-alpha.beta") < ranked.index("1.2.3")
    # Text after a plus sign, too, makes a version lower than the plain release.
    assert order["1.2.3", "1.2.3+build"] == 1 and ranked[-1] == "v2" and {ranked[0], ranked[1]} == {"junk", "V1"}


SCHEMA = "id string, eco string, version string, versions array<string>, ranges array<struct<type:string,events:array<map<string,string>>>>"


def test_ranges(spark):
    span = [{"introduced": "0"}, {"fixed": "1.5.0"}, {"introduced": "2.0.0"}, {"last_affected": "2.3.0"}]
    mixed = [("SEMVER", list(reversed(span)))]
    rows = [
        ("old", "npm", "1.4.9", None, mixed), ("fixed", "npm", "1.5.0", None, mixed), ("pre", "npm", "1.5.0-rc.1", None, mixed),
        ("last", "npm", "2.3.0", None, mixed), ("after", "npm", "2.3.1", None, mixed), ("listed", "npm", "9.9.9", ["9.9.9"], []),
        ("git", "npm", "1.0.0", None, [("GIT", [{"introduced": "0"}])]), ("none", "npm", "1.0.0", None, None),
        ("pyrc", "PyPI", "1.5rc1", None, [("ECOSYSTEM", [{"introduced": "1.0"}, {"fixed": "1.5"}])]),
        ("limit", "npm", "3.0.0", None, [("SEMVER", [{"introduced": "1.0.0"}, {"limit": "3.0.0"}])]),
        ("empty", "npm", "1.0.0", None, [("SEMVER", [])]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id for r in df.where(V.is_affected(F.col("eco"), F.col("version"), F.col("versions"), F.col("ranges"))).collect()}
    assert got == {"old", "pre", "last", "listed", "pyrc"}
    text = df.where("id = 'limit' or id = 'pyrc'").select("id", V.describe_ranges(F.col("ranges")).alias("d")).collect()
    assert {r.id: (r.d.ranges, r.d.fixed) for r in text} == {"pyrc": ([">=1.0, <1.5"], ["1.5"]), "limit": ([">=1.0.0"], [])}


def test_enrich_and_severity(spark):
    deps = spark.createDataFrame([(1, "PyPI", "Some_Lib", "1.0"), (2, "PyPI", "some.lib", "2.0"), (3, "npm", "x", None)], "dep_id int, ecosystem string, name string, version string")
    entries = spark.createDataFrame(
        [("A-1", "PyPI", "some-lib", None, [("ECOSYSTEM", [{"introduced": "0"}, {"fixed": "2.0"}])]), ("A-0", "PyPI", "some-lib", ["1.0"], None)],
        "advisory_id string, ecosystem string, name string, versions array<string>, ranges array<struct<type:string,events:array<map<string,string>>>>",
    )
    got = {r.dep_id: (r.vuln_status, r.advisory_ids) for r in V.enrich(deps, entries).collect()}
    assert got == {1: ("VULNERABLE", ["A-0", "A-1"]), 2: ("NO_KNOWN_VULNERABILITIES", []), 3: ("NOT_VERIFIED", [])}
    assert {r.vuln_status for r in V.enrich(deps, entries, answered=False).collect()} == {"NOT_VERIFIED"}
    rows = [([("CVSS_V2", "x"), ("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")], ["low"]), ([], ["?", "moderate"]), (None, None)]
    sev = spark.createDataFrame(rows, "s array<struct<type:string,score:string>>, l array<string>").select(V.advisory_severity(F.col("s"), F.col("l")).alias("v"))
    assert [r.v for r in sev.collect()] == ["CRITICAL", "MEDIUM", "MEDIUM"]


ENTRIES = "advisory_id string, ecosystem string, name string, versions array<string>, ranges array<struct<type:string,events:array<map<string,string>>>>"


def test_matches_equal_every_pair_judged(spark):
    """Repeated dependencies and entries, advisories with several entries, missing ids, names and versions."""
    import random

    rng = random.Random(2)
    names = ["a.b", "A-b", "c", None]
    deps = [(rng.choice([None, *range(12)]), rng.choice(["PyPI", "npm", None]), rng.choice(names), rng.choice(["1.0", "1.5", "2.0", "3.0rc1", "x", None])) for _ in range(60)]
    span = lambda a, b: ("ECOSYSTEM", [{"introduced": a}, {"fixed": b}])
    entries = [
        (rng.choice([None, "A1", "A2", "A3", "A4"]), rng.choice(["PyPI", "npm"]), rng.choice(names), rng.choice([None, ["1.5"], ["x"]]), rng.choice([None, [], [span("0", "1.5")], [span("1.5", "3.0"), span("0", "1.1")]]))
        for _ in range(25)
    ]
    d, e = spark.createDataFrame(deps, "dep_id int, ecosystem string, name string, version string"), spark.createDataFrame(entries, ENTRIES)
    package = lambda eco, name: name if name is None or eco != "PyPI" else name.lower().replace(".", "-")
    pairs = [(i, x, y) for i, x in enumerate(deps) for y in entries if None not in (x[1], x[2], x[3], y[2]) and x[1] == y[1] and (package(x[1], x[2]) or "").lower() == (package(y[1], y[2]) or "").lower()]
    rows = [(n, x[1], x[3], y[3], y[4]) for n, (_, x, y) in enumerate(pairs)]
    judged = spark.createDataFrame(rows, "id int, eco string, version string, versions array<string>, ranges array<struct<type:string,events:array<map<string,string>>>>")
    hits = {r.id for r in judged.where(V.is_affected(F.col("eco"), F.col("version"), F.col("versions"), F.col("ranges"))).collect()}
    want = {(pairs[n][1][0], pairs[n][2][0]) for n in hits}
    got = [tuple(r) for r in V.advisory_matches(d, e).select("dep_id", "advisory_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    ids = {k: sorted(a for i, a in want if i == k and a is not None) for k in {i for i, _ in want if i is not None}}
    for r in V.enrich(d, e).collect():
        status = "NOT_VERIFIED" if r.version is None else "VULNERABLE" if r.dep_id in ids else "NO_KNOWN_VULNERABILITIES"
        assert (r.vuln_status, r.advisory_ids) == (status, ids.get(r.dep_id, []))
    assert V.enrich(d, e).count() == len(deps)


def test_a_popular_package_is_judged_by_version(spark):
    """300,000 dependencies on one package and 3,000 advisories of two kinds: 900 million pairs, four of them judged."""
    deps = spark.range(300_000).select(F.col("id").alias("dep_id"), F.lit("npm").alias("ecosystem"), F.lit("p").alias("name"), F.when(F.col("id") % 100_000 == 0, "1.0.0").otherwise("5.0.0").alias("version"))
    event = lambda k, v: F.create_map(F.lit(k), v)
    events = F.array(event("introduced", F.lit("0")), event("fixed", F.when(F.col("id") % 3 == 0, "2.0.0").otherwise("1.0.0")))
    entries = spark.range(3000).select(
        F.col("id").alias("advisory_id"), F.lit("npm").alias("ecosystem"), F.lit("p").alias("name"), F.array().cast("array<string>").alias("versions"),
        F.array(F.struct(F.lit("SEMVER").alias("type"), events.alias("events"))).alias("ranges"),
    )
    assert sorted(V.advisory_matches(deps, entries).collect()) == [(d, a) for d in (0, 100_000, 200_000) for a in range(0, 3000, 3)]
    found = V.enrich(deps, entries).groupBy("vuln_status").agg(F.count("*").alias("n"), F.sum(F.size("advisory_ids")).alias("k")).collect()
    assert {tuple(r) for r in found} == {("VULNERABLE", 3, 3000), ("NO_KNOWN_VULNERABILITIES", 299_997, 0)}
