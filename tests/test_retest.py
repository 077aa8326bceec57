import difflib
import functools
import re

from findinglake.operators import retest as R

COLS = "fingerprint string, path string, scanner string, vuln_class string, source_kind string, function string, line int, snippet string, rule_id string"


def row(fp, path="a.py", line=10, snippet="run(user_input, shell=True)", function="f", scanner="s", cls="x", kind="k"):
    return (fp, path, scanner, cls, kind, function, line, snippet, "r")


def test_fuzzy(spark):
    old = [row("o1"), row("o2", line=12), row("o3", line=400, function="g"), row("o4", line=900, function=None), row("o5", cls="y"), row("same", line=1), row("gone", path="b.py")]
    now = [row("n1", line=11, snippet="run(user_input,  shell = True)"), row("n2", line=600, function="g"), row("n3", line=880, function=None), row("same", line=5), row("n5", cls="y", snippet="zzz")]
    make = lambda rows: spark.createDataFrame(rows, COLS)
    history = spark.createDataFrame([("n3",)], "fingerprint string")
    got = {r.fingerprint: (r.result, r.method) for r in R.compare_scans_fuzzy(make(old), make(now), history).collect()}
    assert got == {
        "o1": ("STILL_OPEN", "FUZZY"), "o2": ("RESOLVED", "NONE"), "o3": ("STILL_OPEN", "FUZZY"), "o4": ("RESOLVED", "NONE"), "o5": ("RESOLVED", "NONE"),
        "same": ("STILL_OPEN", "FINGERPRINT"), "gone": ("NOT_REPRODUCED", "NONE"), "n3": ("REGRESSION", "FINGERPRINT"), "n5": ("NEW", "NONE"),
    }


def test_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    make = lambda p: [(f"{p}{i}", i, "a.py", rng.choice("xy"), "k", rng.choice(["f", "g", "", None]), rng.choice([None, *range(80)]), rng.choice(["abcd", "abce", "wxyz", None]), rng.choice("rs")) for i in range(60)]
    schema = "id string, ord int, path string, vuln_class string, source_kind string, function string, line int, snippet string, rule_id string"
    a, b = make("a"), make("b")
    want = {}
    for x in a:
        for y in b:
            same = bool(x[5]) and x[5] == y[5]
            near = x[6] is not None and y[6] is not None and abs(x[6] - y[6]) <= 15
            sim = difflib.SequenceMatcher(None, x[7] or "", y[7] or "").ratio()
            if x[3] == y[3] and (same or near) and sim >= 0.6:
                want[x[0], y[0]] = round(sim + 0.5 * same + 0.3 * near + 0.2 * (x[8] == y[8]), 9)
    got = R.candidate_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    assert {(r.base, r.cur): round(r.score, 9) for r in got} == want and len(got) == len(want)


def _fold(pairs):
    """The sequential rule over (base, ord, cur, cur_ord, score)."""
    free, out, own = {p[2] for p in pairs}, {}, {}
    for p in pairs:
        own.setdefault((p[1], p[0]), []).append(p)
    for key in sorted(own):
        for p in sorted(own[key], key=lambda p: (-p[4], p[3], p[2])):
            if p[2] in free:
                free.discard(p[2])
                out[p[0]] = p[2]
                break
    return out


def test_assignment_in_rounds(spark):
    """Connected groups far over the bound, ties and equal orders included, give what the sequential rule gives."""
    import random

    rng = random.Random(11)
    pairs = [(f"b{b}", b * 7 % 40, f"c{c}", c % 7, rng.choice([0.6, 0.7, 0.8])) for b in range(60) for c in range(60) if abs(b - c) < 4 and rng.random() < 0.8]
    df = spark.createDataFrame(pairs, "base string, ord int, cur string, cur_ord int, score double")
    for bound in (10, 10_000):
        got = R.assigned(df, bound=bound).collect()
        assert {r.base: r.cur for r in got} == _fold(pairs) and len(got) == len(_fold(pairs))
    assert R.assigned(df.limit(0)).count() == 0


def test_many_findings_in_one_file(spark):
    from pyspark.sql import functions as F

    side = lambda p, step: spark.range(50_000).select(
        F.sha1(F.concat(F.lit(p), F.col("id").cast("string"))).alias("id"), F.sha1(F.concat(F.lit(p), F.col("id").cast("string"))).alias("ord"), F.lit("a.py").alias("path"), F.lit("x").alias("vuln_class"),
        F.lit("k").alias("source_kind"), F.lit(None).cast("string").alias("function"), (F.col("id") * 4 + step).cast("int").alias("line"), F.concat(F.lit("call(value"), (F.col("id") % 3).cast("string"), F.lit(")")).alias("snippet"), F.lit("r").alias("rule_id"),
    )
    old, now = side("o", 0), side("n", 1)
    pairs = R.candidate_pairs(old, now).select("base", "ord", "cur", "cur_ord", "score").collect()
    got = {r.base: r.cur for r in R.fuzzy_matches(old, now).collect()}
    assert len(pairs) > 300_000 and got == _fold([tuple(r) for r in pairs])


def test_query_on_changed_code_by_brute_force(spark, sf):
    """The registered query over the whole table, by the rule read literally."""
    from findinglake.plans import lake

    old, now = ([r.asDict() for r in df.collect()] for df in lake.changed_code(spark, sf))
    plain = lambda t: re.sub(r"\s+", " ", (t or "").strip())[:500]
    ratio = functools.lru_cache(None)(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())
    place = lambda r: (r["path"], r["vuln_class"], r["source_kind"])
    free, want = {}, {}
    for r in now:
        free.setdefault(place(r), {})[r["fingerprint"]] = r
    paths = {r["path"] for r in now}
    for b in sorted(old, key=lambda r: r["fingerprint"]):
        best = None
        for fp in sorted(free.get(place(b), {})):
            c = free[place(b)][fp]
            same = bool(b["function"]) and b["function"] == c["function"]
            near = b["line"] is not None and c["line"] is not None and abs(b["line"] - c["line"]) <= 15
            sim = ratio(plain(b["snippet"]), plain(c["snippet"])) if same or near else 0
            score = sim + 0.5 * same + 0.3 * near + 0.2 * (b["rule_id"] == c["rule_id"])
            if sim >= 0.6 and (best is None or score > best[0] + 1e-12):
                best = score, fp
        if best:
            del free[place(b)][best[1]]
            want[b["fingerprint"]] = ("STILL_OPEN", "FUZZY")
        else:
            want[b["fingerprint"]] = ("RESOLVED" if b["path"] in paths else "NOT_REPRODUCED", "NONE")
    want |= {fp: ("NEW", "NONE") for own in free.values() for fp in own}
    got = {r.fingerprint: (r.result, r.method) for r in lake.QUERIES["retest_changed_code"](spark, sf).collect()}
    assert got == want and sum(m == "FUZZY" for _, m in got.values()) > 50


def test_equal_findings_are_queues(spark):
    """Findings that only their order tells apart: pairs would be four million, and each round of pairs settles one."""
    from pyspark.sql import functions as F

    side = lambda p: spark.range(2000).select(
        F.format_string(f"{p}%05d", "id").alias("fingerprint"), F.lit("a.py").alias("path"), F.lit("s").alias("scanner"), F.lit("x").alias("vuln_class"), F.lit("k").alias("source_kind"),
        F.lit("f").alias("function"), F.lit(3).alias("line"), F.lit("run(x)").alias("snippet"), F.lit("r").alias("rule_id"),
    )
    old, now = side("o"), side("n").limit(1500)
    got = {(r.fingerprint, r.result, r.method) for r in R.compare_scans_fuzzy(old, now, old.select("fingerprint").limit(0)).collect()}
    assert got == {(f"o{i:05d}", "STILL_OPEN", "FUZZY") if i < 1500 else (f"o{i:05d}", "RESOLVED", "NONE") for i in range(2000)}
    shape = lambda df: df.withColumns({"id": F.col("fingerprint"), "ord": F.col("fingerprint")})
    assert {(r.base, r.cur) for r in R.fuzzy_matches(shape(old), shape(now)).collect()} == {(f"o{i:05d}", f"n{i:05d}") for i in range(1500)}


def test_places_and_pairs_agree(spark):
    """Nulls, repeated and missing fingerprints, in places settled at once and in places settled by their pairs."""
    import random

    from findinglake.operators.findings import compare_scans

    rng = random.Random(5)
    some = lambda p, n: [
        row(rng.choice([f"{p}{i}", f"{p}{i}", f"{p}{i // 3}", f"both{i}"]), path=rng.choice(["a.py", "b.py"]), line=rng.choice([None, *range(60)]), snippet=rng.choice(["abcd", "abce", "wxyz", None]),
            function=rng.choice(["f", "g", "", None]), scanner=rng.choice("st")) for i in range(n)
    ]
    odd = [row(None), row(None, path=None), row("nopath", path=None), row("kindless", kind=None)]
    old = spark.createDataFrame(some("o", 120) + odd, COLS)
    now = spark.createDataFrame(some("n", 80) + odd[:2], COLS)
    history = spark.createDataFrame([("n1",), ("n1",), ("both3",)], "fingerprint string")
    run = lambda **k: sorted((r.fingerprint or "", r.result, r.method) for r in R.compare_scans_fuzzy(old, now, history, **k).collect())
    got = run()
    assert got == run(most=0) == run(most=0, bound=10) and sum(m == "FUZZY" for _, _, m in got) > 20
    exact = [r for r in compare_scans(old, now, history).collect()]
    taken = len(exact) - len(got)  # current findings that an earlier one took aren't reported
    firsts = {f for f, _, m in got if m == "FUZZY"}
    assert taken == len(firsts) > 10
    assert sorted((r.fingerprint or "", r.result) for r in exact if r.fingerprint not in firsts and r.result != "NEW" and r.result != "REGRESSION") == sorted(
        (f, r) for f, r, _ in got if f not in firsts and r not in ("NEW", "REGRESSION")
    )
