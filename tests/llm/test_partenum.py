import random

import numpy as np

from findinglake.llm.partenum import jaccard_groups, signatures


def _brute(rows, size=5, percent=80):
    def shingle(t):
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        if not w:
            return frozenset()
        return frozenset([tuple(w)] if len(w) < size else (tuple(w[i : i + size]) for i in range(len(w) - size + 1)))

    sets = {d: shingle(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def _rows(seed, n=160):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.6:
            w = list(rnd.choice(texts))
            for _ in range(rnd.choice([0, 1, 1, 2, 3] if len(w) > 60 else [0, 1])):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        else:
            w = [rnd.choice(vocabulary) for _ in range(rnd.choice([0, 1, 3, 4, 5, 6, 9, 20, 45, 45, 60, 90, 90, 200, 200, 300]))]
        texts.append(w)
        out.append((i, " ".join(x.upper() if rnd.random() < 0.1 else x for x in w)))
    rnd.shuffle(out)
    return out


def _found(df, **more):
    return sorted(tuple(r) for r in jaccard_groups(df, **more).collect())


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = _rows(seed)
        want = _brute(rows)
        assert len({c for _, _, c in want}) < 0.85 * len(rows)
        df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, id int")
        assert _found(df, block=512 if seed == 1 else 3) == want
        if seed == 1:
            assert _found(df) == want  # stars of one task


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One  two"), (5, "One  two"), (None, "one two")]
    out = jaccard_groups(spark.createDataFrame(rows, schema)).collect()
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in out)
    assert got == [(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4)]
    assert jaccard_groups(spark.createDataFrame([], schema)).count() == 0


def test_signatures_meet_for_similar_sets():
    """Sets as far apart as the threshold allows share a signature, whatever their sizes."""
    rng = np.random.default_rng(1)
    for n in [1, 2, 3, 4, 5, 6, 8, 11, 14, 20, 33, 60, 100, 250, 700]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = [(x, y) for x in range(n + 1) for y in range(n // 4 + 2) if 100 * (n - x) >= 80 * (n + y)]
            x, y = most[rng.integers(len(most))]
            b = np.unique(np.append(a[rng.permutation(a.size)[x:]], rng.integers(0, 2**63, y).astype(np.uint64)))
            sigs, owner = signatures([a, b], 80)
            assert np.intersect1d(sigs[owner == 0], sigs[owner == 1]).size, (n, x, y)
