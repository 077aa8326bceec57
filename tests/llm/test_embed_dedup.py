import numpy as np
from pyspark.sql import functions as F

from findinglake.llm.embed_dedup import embedding_groups


def _brute(rows, least=0.98):
    ok = [
        d is not None and v is not None and l is not None and None not in v and np.isfinite(v).all() and any(v)
        for d, v, l in rows
    ]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for o, (_, v, _) in zip(ok, rows)]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least_id = {}
    for i, (d, _, _) in enumerate(rows):
        if ok[i]:
            least_id[find(i)] = min(d, least_id.get(find(i), d))
    return sorted((d, links[i], least_id[find(i)] if ok[i] else d) for i, (d, _, _) in enumerate(rows) if d is not None)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 32)).astype(np.float32)
    rows = []
    for i in range(400):
        v = base[rng.integers(40)] + rng.standard_normal(32).astype(np.float32) * rng.choice([0, 0.05, 0.1, 0.15])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(3))))
    rows += [(500, None, 1), (501, [0.0] * 32, 1), (502, [float("nan")] + [1.0] * 31, 1), (503, rows[0][1], None),
             (504, [None] + [1.0] * 31, 2), (505, [float("inf")] * 32, 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for block in (1024, 7):
        out = embedding_groups(df, block=block).collect()
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in out if r.vec_id is not None)
        assert got == _brute(rows)
        assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
        assert len(out) == len(rows)
    assert embedding_groups(df.limit(0)).count() == 0


def test_shared_ids_lengths_and_names(spark):
    """Rows of one vec_id are vectors of their own; lengths, labels of strings and other columns mix up nothing."""
    rng = np.random.default_rng(5)
    a, b = (rng.standard_normal(16) for _ in range(2))
    near = lambda v: [float(x) for x in v + rng.standard_normal(16) * 0.01]
    a, b = [float(x) for x in a], [float(x) for x in b]
    rows = [(1, a, "x"), (1, b, "x"), (2, near(a), "x"), (3, near(b), "x"), (4, near(a), "x"), (5, a[:8], "x"),
            (6, a[:8], "x"), (7, a, "y"), (8, a + [0.0], "x"), (9, [], "x"), (-3, near(b), "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for c in ("n", "rep", "key", "component", "first_id"):
        df = df.withColumn(c, F.lit(1))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_groups(df, block=3).collect())
    want = [(-3, 2, -3), (1, 2, -3), (1, 2, 1), (2, 2, 1), (3, 2, -3), (4, 2, 1), (5, 1, 5), (6, 1, 5), (7, 0, 7), (8, 0, 8), (9, 0, 9)]
    assert got == want


def test_recall_on_a_table(spark, sf):
    """All pairs within each label, by matrix products, against the links found."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label")
    got = {r.vec_id: r.n_links for r in embedding_groups(df).collect()}
    for _, own in df.toPandas().groupby("label"):
        x = np.stack(own["embedding"]).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        want = ((x @ x.T) >= 0.98).sum(1) - 1
        assert [got[i] for i in own["vec_id"]] == want.tolist()
