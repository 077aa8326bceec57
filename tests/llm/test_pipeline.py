"""The pipeline, stage by stage, against plain computations over the stage's own input."""

import numpy as np

import corpus_pipeline as P
from findinglake.llm import quality_mcd, toxicity
from findinglake.llm.suffix_dedup import remove_repeats_by_brute_force
from tests.llm.test_partenum import _brute

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted((tuple(r) for r in df.select(*P.COLUMNS).collect()), key=str)


def _input(spark, extra=()):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    return docs.unionByName(spark.createDataFrame(list(extra), docs.schema)) if extra else docs


def test_names_and_columns(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "repeats", "packing"]
    docs = _input(spark).limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == P.COLUMNS and out.dtypes == docs.dtypes


def test_toxicity_keeps_what_scores_low(spark):
    docs = _input(spark, [(None, "some harmless words", "en", "s", 19), (5_000_000_000, None, None, None, 0)]).cache()
    w = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    size = w.size - 1

    def score(text):  # noisy-or over sentences, by definition
        f, sentence, doc, _ = toxicity.features([text.encode()])
        s = [w[size] + float(w[f[sentence == k]].sum()) for k in range(doc.size)]
        return 1 - float(np.prod([1 - 1 / (1 + np.exp(-x)) for x in s]))

    want = sorted((tuple(r) for r in docs.collect() if score(r.text or "") < 0.3), key=str)
    assert _rows(P.drop_toxic(spark, docs, SF)) == want and len(want) > 100


def test_quality_keeps_by_each_rows_own_verdict(spark):
    docs = _input(spark, [(None, "too short", "en", "s", 9), (1, "too short", "en", "s", 9)]).cache()
    kept = [r.asDict() for r in quality_mcd.judged(docs).where("kept").collect()]
    by = {(r["doc_id"], r["lang"], r["source"], r["n_words"]) for r in kept}
    want = sorted((tuple(r) for r in docs.collect() if (r.doc_id, r.lang, r.source, len((r.text or "").split())) in by), key=str)
    assert _rows(P.keep_quality(spark, docs, SF)) == want and not any(r[1] == "too short" for r in want)


def test_one_of_each_group_stays(spark):
    docs = _input(spark).limit(120)
    some = docs.first()
    docs = docs.unionByName(spark.createDataFrame([(900, some.text, "en", "s", 1), (some.doc_id, *tuple(some)[1:]), (None, some.text, "en", "s", 1)], docs.schema)).cache()
    rows = [tuple(r) for r in docs.collect()]
    groups = {d: c for d, _, c in _brute([(r[0], r[1]) for r in rows if r[0] is not None])}
    want = {r for r in rows if r[0] is None or groups[r[0]] == r[0]}
    assert _rows(P.one_of_each(spark, docs, SF)) == sorted(want, key=str)


def test_repeats_are_cut(spark):
    docs = _input(spark).limit(60).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {d: n - gone for d, n, gone, _, _ in remove_repeats_by_brute_force(rows)}
    got = {r.doc_id: r for r in P.cut_repeats(spark, docs, SF).collect()}
    assert set(got) == {d for d, n in want.items() if n}
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert all(len(r.text.replace("�", "").encode()) <= want[d] for d, r in got.items())


def test_run_is_its_stages(spark):
    docs = _input(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert sorted(map(str, docs.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(
        map(str, P.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect())
    )
