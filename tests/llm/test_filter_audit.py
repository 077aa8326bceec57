import re
from itertools import permutations

from findinglake.llm.filter_audit import filter_audit

LONG = " ".join(f"w{i}" for i in range(60_000))
FIFTY = " ".join(f"v{i}" for i in range(50))
ROWS = [
    (1, None, "a"), (2, "", "b"), (3, "x", None), (None, "x", "a"), (None, "x", "a"), (3, "x", None), (5, FIFTY, "a"), (6, FIFTY, "b"), (7, FIFTY, "b"),
    (None, FIFTY, ""), (None, "only without id", "a"), (None, "only without id", "b"), (8, LONG, "a"), (8, FIFTY + " 50% off", "a"), (9, "AB " * 50, "c"),
    (2**63 - 1, "AB " * 50, "c"), (-(2**63), "é𝒳 word\x0bword\x1cword", "c"), (10, FIFTY.upper(), "b"), (11, "a b " * 30, "b"), (12, "x", "b"),
]
LABELS = [(1, 1, 0), (2, None, 1), (5, 1, 1), (6, 0, 1), (6, 1, None), (None, 1, 1), (8, 1, 0), (9, 0, 1), (404, 1, 1), (11, 1, 1)]
SCHEMA = "doc_id long, text string, source string, part string, n int, key string, good int, spread long"


def _tables(spark, rows=ROWS):
    docs = spark.createDataFrame([(d, t, s, "p", 1, "k", 2, 3) for d, t, s in rows], SCHEMA)
    return docs, spark.createDataFrame([(*x, "z") for x in LABELS], "doc_id long, quality int, toxic int, spread string")


def _plain(rows, labels):
    """Each document through each order, one after the other."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    judged = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [x for x, y, _ in rows if (y or "") == t and x is not None and (d is None or x < d)]
        caps = len(re.findall("[A-Z]", t))
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * caps > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(same)}
        judged.append((s or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in judged}:
        gone = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in judged if x[0] == part]
            for step, c in enumerate(order, 1):
                here = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                failing = [x for x in judged if x[0] == part and c in x[1]]
                gone[c] += len(here)
                out[part, order, step] = [len(left), len(here), len(failing) - len(here), sum(len(x[1]) == 1 for x in failing), sum(x[2] for x in here), sum(x[3] for x in here)]
        for key in out:
            if key[0] == part:
                out[key].append(gone[key[1][key[2] - 1]])
    return out


def test_by_brute_force(spark, sf):
    docs, labels = _tables(spark)
    assert {tuple(r)[:3]: list(r)[3:] for r in filter_audit(docs, labels).collect()} == _plain(ROWS, LABELS)
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = _plain([(r.doc_id, r.text, r.source) for r in docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert {tuple(r)[:3]: list(r)[3:] for r in filter_audit(docs, labels).collect()} == want


def test_empty_tables(spark):
    docs, labels = _tables(spark)
    assert filter_audit(docs.limit(0), labels).count() == 0
    assert filter_audit(docs, labels.limit(0)).count() == 600 * 4
