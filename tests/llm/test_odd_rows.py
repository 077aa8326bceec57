"""All operators on documents on the same odd rows: large, repeated and missing ids, extra columns, empty and long texts."""

import pytest

from findinglake.llm import licenses, lm_score, packing, partenum, piece_lattice, quality_mcd, sharding, suffix_dedup, toxicity

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(40_000))
IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63), None, None, 7, 7, 7, 8]
TEXTS = ["one two", None, "", "x", LONG, "no id", "same text here", "same text here", "other text", " \n\t"]
SCHEMA = "doc_id long, text string, lang string, source string, size int, shard int, chunk int, id string, label string, n string, kept int"


def _docs(spark):
    rows = [(d, t, None if i % 3 == 0 else "en", "s" if i % 2 else None, 1, 2, 3, "x", "y", "z", 4) for i, (d, t) in enumerate(zip(IDS, TEXTS))]
    return spark.createDataFrame(rows, SCHEMA)


def _score(docs):
    target = docs.where("doc_id = 7").select("doc_id").unionByName(docs.where("doc_id is null").select("doc_id"))
    return lm_score.cross_entropy_difference(docs, target)


def _toxic(docs):
    labels = docs.sparkSession.createDataFrame([(7, 1), (8, 0), (None, 1), (2**53 + 1, None)], "doc_id long, toxic int")
    return toxicity.toxicity_scores(docs, labels)


OPERATORS = {
    "suffix_dedup": suffix_dedup.repeats_digest,
    "piece_lattice": piece_lattice.encode,
    "lm_score": _score,
    "sharding": sharding.shard,
    "licenses": licenses.scan_licenses,
    "quality": quality_mcd.quality_rules,
    "packing": packing.pack,
    "partenum": partenum.jaccard_groups,
    "toxicity": _toxic,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay(spark, name):
    rows = OPERATORS[name](_docs(spark)).collect()
    got = [r.doc_id for r in rows]
    if name == "packing":  # a row for each piece
        got = [r.doc_id for r in rows if r.piece == 0]
        assert sum(r.length for r in rows if r.doc_id is None) > 40_000
    assert sorted(got, key=str) == sorted(IDS, key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](_docs(spark).limit(0)).count() == 0


def test_shared_ids_keep_links(spark):
    """Two rows of one id: what is similar to either is linked."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, "z"), (2**53 + 1, a + " q"), (None, a)]
    got = partenum.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (2**53 + 1, 1)]
    kept = partenum.first_of_each(spark.createDataFrame([*rows, (4, "z")], "doc_id long, text string").selectExpr("*", "1 as n_chars")).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(0, a), (1, a), (1, b), (4, "z")])
