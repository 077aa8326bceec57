import hashlib
import re

import pytest
from pyspark.sql import functions as F

from findinglake.llm.fill_middle import UNITS, escape, fill_in_middle, fill_in_middle_digest, marked, restore, unescape

LONG = "é𝒳\x01\x02e" * 40_000
TEXTS = [
    (1, None), (2, ""), (3, "a"), (4, "\x01"), (5, "\x02\x01d\x02e\x02"), (6, "has <P> in it"), (7, "𝒳𝒴𝒵 é́ \n\x00 x"), (7, "other of 7"),
    (None, "no id"), (None, "no id"), (2**63 - 1, "$0 \\1 %s"), (-5, "<" * 9 + "S>"[:1]), (8, LONG), (9, "<S><S"), (10, "tail <"),
]
SCHEMA = "doc_id long, text string, n string, output int, _text string, row string, form int"


def _docs(spark, rows=TEXTS):
    return spark.createDataFrame([(d, t, "n", 1, "t", "r", 2) for d, t in rows], SCHEMA)


def _plain(d, t):
    """The contract, read literally."""
    t = t or ""
    h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, sha = len(t), lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (d, n, "plain", None, None, sha(t), sha(t))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    out = f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}" if h4 % 100 < 20 else f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"
    return (d, n, "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(out), sha(t))


def test_digest_by_brute_force(spark, sf):
    many = [(i, f"text {i} \x02\x01 𝒳") for i in range(300)]
    got = [tuple(r) for r in fill_in_middle_digest(_docs(spark, TEXTS + many)).collect()]
    assert sorted(got, key=str) == sorted((_plain(d, t) for d, t in TEXTS + many), key=str)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((_plain(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in fill_in_middle_digest(docs).collect()), key=str) == want
    assert {x[2] for x in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("unit,pattern", [("char", "(?s)."), ("word", r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"), ("line", "[^\n]*\n|[^\n]+")])
def test_units(spark, unit, pattern):
    """Parts are whole units of any kind, and the text comes back."""
    assert unit in UNITS
    rows = {(r.doc_id, r.restored): r for r in fill_in_middle(_docs(spark), unit).withColumn("restored", restore(F.col("output"), F.col("form"))).collect()}
    assert {(d, t or "") for d, t in TEXTS} == set(rows)
    for (d, t), r in rows.items():
        units = re.findall(pattern, t)
        assert (r.n, "".join(units)) == (len(units), t)
        if r.form != "plain":
            k, m = len(re.findall(pattern, r.prefix)), len(re.findall(pattern, r.middle))
            assert (r.prefix, r.middle, r.suffix) == ("".join(units[:k]), "".join(units[k : k + m]), "".join(units[k + m :]))


def test_escapes(spark):
    df = _docs(spark).select("text", escape(F.col("text")).alias("e"), unescape(marked(F.col("text"))).alias("back"))
    assert all(r.text is None or ("\x01" not in r.e and r.back == r.text) for r in df.collect())


def test_columns_and_empty_table(spark):
    made = fill_in_middle(_docs(spark).withColumn("lang", F.lit("en")).limit(0))
    assert made.columns == ["doc_id", "text", "_text", "row", "lang", "n", "form", "prefix", "middle", "suffix", "output"]
    assert made.count() == 0 and fill_in_middle_digest(_docs(spark).limit(0)).count() == 0
