import random
import zlib
from collections import Counter

from findinglake.llm.sharding import communication_matrix, hypergeometric, shard


def test_shards_are_exact(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(None, None), (7, ""), (7, ""), (7, "")], docs.schema)
    docs = docs.unionByName(more)
    rows = shard(docs, rows=20).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    assert sorted(map(tuple, shard(docs, rows=20).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert shard(docs.limit(0)).count() == 0


def test_many_equal_rows(spark, monkeypatch):
    """A group of more copies than a block holds; the result doesn't depend on the block's size."""
    from findinglake.llm import sharding

    docs = spark.range(5000).selectExpr("cast(null as long) as doc_id", "if(id < 4990, cast(null as string), 'a') as text", "id as n", "1 as copy")
    want = sorted(map(tuple, shard(docs, rows=100).collect()), key=str)
    assert len(want) == 5000 and Counter(r[4] for r in want) == {s: 625 for s in range(8)}
    monkeypatch.setattr(sharding, "_COPIES", 7)
    assert sorted(map(tuple, shard(docs, rows=100).collect()), key=str) == want


def test_no_python_in_the_plan(spark, sf):
    plan = shard(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_hypergeometric_law():
    rnd = random.Random(5)
    got = Counter(hypergeometric(6, 9, 5, rnd) for _ in range(20000))
    from math import comb

    for k in range(6):
        p = comb(6, k) * comb(9, 5 - k) / comb(15, 5)
        assert abs(got[k] / 20000 - p) < 0.015
    x = hypergeometric(3 * 10**10, 2 * 10**11, 10**6, rnd)
    assert abs(x - 10**6 * 3 / 23) < 3000


def test_matrix_margins():
    m = communication_matrix([10, 0, 7, 33], [13, 12, 25], random.Random(1))
    assert [sum(x) for x in m] == [10, 0, 7, 33] and [sum(x) for x in zip(*m)] == [13, 12, 25]
