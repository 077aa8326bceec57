"""Outcomes of scans by brute force, and their odd rows."""

import difflib
import random
import re

from findinglake.operators import outcomes as U
from findinglake.operators import reports

FINDING = "scan_id long, ord long, fingerprint string, rule_id string, vuln_class string, source_kind string, path string, line int, function string, snippet string, scanners array<string>"
FIELDS = re.findall(r"(\w+) \w", FINDING)


def _plain(t):
    return re.sub(r"\s+", " ", (t or "").strip())[:500]


def _score(b, c):
    if b["path"] is None or any(b[x] != c[x] for x in ("path", "vuln_class", "source_kind")):
        return 0
    same = bool(b["function"]) and b["function"] == c["function"]
    near = b["line"] is not None and c["line"] is not None and abs(b["line"] - c["line"]) <= 15
    sim = difflib.SequenceMatcher(None, _plain(b["snippet"]), _plain(c["snippet"])).ratio()
    return sim + 0.5 * same + 0.3 * near + 0.2 * (b["rule_id"] == c["rule_id"]) if (same or near) and sim >= 0.6 else 0


def _one_scan(base, cur, partial, analysed, ran, history):
    """The rule read literally, a row at a time."""
    now = {}
    for c in sorted(cur, key=lambda c: c["ord"]):
        place = now[c["fingerprint"]]["ord"] if c["fingerprint"] in now else c["ord"]
        now[c["fingerprint"]] = {**c, "ord": place}
    free, out, pending = dict(now), [], []
    for b in sorted(base, key=lambda b: b["ord"]):
        if b["fingerprint"] in free:
            out.append((b["ord"], free.pop(b["fingerprint"])["ord"], "STILL_OPEN", "FINGERPRINT"))
        else:
            pending.append(b)
    for b in pending:
        best = None
        for c in sorted(free.values(), key=lambda c: c["ord"]):
            s = _score(b, c)
            if s and (best is None or s > best[0] + 1e-12):
                best = s, c
        if best:
            out.append((b["ord"], free.pop(best[1]["fingerprint"])["ord"], "STILL_OPEN", "FUZZY"))
            continue
        needed = {"dependency-advisories"} if b["source_kind"] == "DEPENDENCY" else {s.split(":")[0] for s in b["scanners"] or []}
        if b["path"] is not None and b["path"] not in analysed:
            result = "NOT_TESTED" if partial else "NOT_REPRODUCED"
        else:
            result = "RESOLVED" if needed & ran else "NOT_TESTED"
        out.append((b["ord"], None, result, "NONE"))
    for fp, c in free.items():
        out.append((None, c["ord"], *(("REGRESSION", "FINGERPRINT") if fp in history else ("NEW", "NONE"))))
    return out


def test_retests_by_brute_force(spark):
    rng = random.Random(5)
    code = ["run(cmd, shell=True)", "run(cmd,  shell=False)", "query('select ' + name)", "open(path)", None, ""]

    def finding(scan, ord_):
        kind = rng.choice(["SAST", "SAST", "DEPENDENCY"])
        return (
            scan, ord_, f"fp{rng.randrange(60)}", rng.choice(["r1", "r2"]), rng.choice("xxxy"), kind, rng.choice(["a.py", "b.py", "c.py", None]), rng.choice([None, *range(1, 30)]),
            rng.choice([None, "", "f", "g"]), rng.choice(code), rng.choice([None, [], ["sast:flow"], ["bandit", "sast"], ["semgrep"]]),
        )

    base = [finding(s, i * 10 + s) for s in (1, 2, 3) for i in range(40)]
    cur = [finding(s, i * 10 + s) for s in (1, 2, 3, 4) for i in range(30)]
    partial = {1: True, 2: False, 3: None, 4: False}
    analysed = {1: {"a.py"}, 2: {"a.py", "b.py"}, 3: {"a.py", "b.py", "c.py"}, 4: set()}
    ran = {1: {"sast", "dependency-advisories"}, 2: {"bandit"}, 3: set(), 4: {"sast"}}
    history = {s: {"fp1", "fp2", "fp3", "fp4", "fp5"} for s in (1, 4)} | {2: set(), 3: set()}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = [
        df([(s, p) for s, p in partial.items()], "scan_id long, partial boolean"),
        df([(s, p, "ANALYZED" if p in ps else "SKIPPED_SIZE") for s, ps in analysed.items() for p in ("a.py", "b.py", "c.py")], "scan_id long, path string, status string"),
        df([(s, n, "ran" if n in ns else "failed") for s, ns in ran.items() for n in ("sast", "bandit", "dependency-advisories")], "scan_id long, scanner string, status string"),
        df([(s, f) for s, fs in history.items() for f in fs], "scan_id long, fingerprint string"),
    ]
    got = U.retests(df(base, FINDING), df(cur, FINDING), *args).collect()
    rows = lambda side, s: [dict(zip(FIELDS, r)) for r in side if r[0] == s]
    want = [(s, *x) for s in partial for x in _one_scan(rows(base, s), rows(cur, s), partial[s], analysed[s], ran[s], history[s])]
    assert sorted(((r.scan_id, r.base_ord, r.cur_ord, r.result, r.match) for r in got), key=repr) == sorted(want, key=repr)
    assert {"FUZZY", "FINGERPRINT", "NONE"} == {r.match for r in got} and len({r.result for r in got}) == 6 and all(r.note for r in got)
    assert U.retests(df([], FINDING), df([], FINDING), *args).count() == 0


def test_slugs_stay_unique(spark):
    old = [(1, "web-app"), (1, "web-app-3"), (1, "api-2"), (None, "web-app")]
    names = [(1, "Web App", 1), (1, "web app!", 2), (1, "API", 3), (1, "api", 4), (1, "Web app 2", 5), (1, "web-app", 6), (1, None, 7), (1, "??", 8), (2, "Web App", 9), (None, "Web App", 10), (1, "api 02", 11), (1, "x" * 300, 12), (1, "x" * 300, 13)]
    out = U.unique_slugs(spark.createDataFrame(old, "organization_id long, slug string"), spark.createDataFrame(names, "organization_id long, name string, ord long"))
    got = {r.ord: r.slug for r in out.collect()}
    assert got == {
        1: "web-app-4", 2: "web-app-5", 3: "api", 4: "api-3", 5: "web-app-2", 6: "web-app-6", 7: "item", 8: "item-2", 9: "web-app", 10: "web-app-2", 11: "api-02",
        12: "x" * 100, 13: "x" * 100 + "-2",
    }
    assert U.unique_slugs(spark.createDataFrame([], "organization_id long, slug string"), out.drop("slug").limit(0)).count() == 0


def test_many_rows_of_one_name(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200_000).select(F.lit(1).alias("organization_id"), F.lit("Same").alias("name"), F.col("id").alias("ord"))
    old = spark.range(2, 100_000, 3).select(F.lit(1).alias("organization_id"), F.concat(F.lit("same-"), F.col("id").cast("string")).alias("slug"))
    out = U.unique_slugs(old, rows)
    last = out.orderBy(F.desc("ord")).first().slug
    assert out.select("slug").distinct().count() == 200_000 and out.join(old, "slug").count() == 0
    assert last == f"same-{200_000 + old.count()}"  # no number is left out


def test_files_after_scanners(spark):
    files = spark.createDataFrame([(1, "a", "ANALYZED", None), (1, "b", "ANALYZED", "old"), (2, "a", "SKIPPED_SIZE", None)], "scan_id long, path string, status string, detail string")
    told = spark.createDataFrame([(1, "a", 1, "warning"), (1, "a", 2, "parser failure at 3"), (2, "a", 1, "recovered"), (9, "z", 1, "failure")], "scan_id long, path string, ord long, detail string")
    got = {(r.scan_id, r.path): (r.status, r.detail) for r in U.files_after(files, told).collect()}
    assert got == {(1, "a"): ("PARSE_ERROR", "parser failure at 3"), (1, "b"): ("ANALYZED", "old"), (2, "a"): ("SKIPPED_SIZE", "recovered")}


def test_audit_is_appended(spark, tmp_path):
    import datetime as dt

    row = lambda i, day: (i, dt.datetime(2024, 5, day, 23), "agent" * 100, {"k": "v" * 5000})
    schema = "event_id long, created_at timestamp, user_agent string, details map<string,string>"
    for batch in ([row(1, 1), row(2, 2)], [row(3, 2)], []):
        reports.append_audit(spark.createDataFrame(batch, schema), str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.event_id, str(r.day)) for r in got) == [(1, "2024-05-01"), (2, "2024-05-02"), (3, "2024-05-02")]
    assert all(len(r.user_agent) == 300 and len(r.details["k"]) == 2000 for r in got)
