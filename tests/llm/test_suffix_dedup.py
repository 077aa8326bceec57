import hashlib
import random

import numpy as np

from findinglake.llm.suffix_dedup import lpf_array, remove_repeats, remove_repeats_by_brute_force


def _texts(seed=1, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(6, 40))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 4))]
        for p in rnd.sample(passages, rnd.randint(0, 3)):
            cut = rnd.randint(0, len(p) // 2)
            parts.insert(rnd.randint(0, len(parts)), p[cut:])
        out.append((i, "".join(parts)))
    out += [(n + 1, out[3][1]), (n + 2, out[3][1]), (n + 3, "a" * 400), (n + 4, "a" * 60), (n + 5, "")]
    rnd.shuffle(out)
    return out


def _found(df, length, hot=4000):
    out = remove_repeats(df, length, hot=hot).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)


def test_equals_brute_force(spark):
    rows = _texts()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, kept string").repartition(5)
    want = sorted(remove_repeats_by_brute_force(rows))
    assert sum(r[2] for r in want) > 2000
    assert _found(df, 50) == want
    assert _found(df, 50, hot=3) == want  # the path for anchors of many documents
    want = sorted(remove_repeats_by_brute_force(rows, 24))
    assert _found(df, 24, hot=10) == want


def test_nulls_ties_and_empty(spark):
    long = "some words that go on for well over fifty bytes, all the same, to the end"
    schema = "doc_id long, text string"
    rows = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (4, long), (None, long)], schema)
    out = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in remove_repeats(rows).collect()}
    assert out[(3, len(long))] == (0, 0) and out[(4, len(long))] == (len(long), 1)
    assert out[(None, len(long))] == (len(long), 1) and out[(1, 0)] == out[(2, 0)] == (0, 0)
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_lpf_array_by_definition():
    rnd = np.random.default_rng(3)
    for length in (9, 16, 50):
        buf = rnd.integers(0, 2, 700).astype(np.uint8)
        buf[400:480] = buf[100:180]
        at = np.sort(rnd.choice(700 - length, 300, replace=False))
        doc = rnd.integers(0, 40, 300)
        got = lpf_array(buf, at, doc, length)
        for i in range(300):
            own, best = buf[at[i] : at[i] + length], 0
            for j in np.flatnonzero(doc < doc[i]):
                differ = np.flatnonzero(own != buf[at[j] : at[j] + length])
                best = max(best, int(differ[0]) if differ.size else length)
            assert got[i] == best


def test_large_ids_long_texts_and_columns(spark):
    """Ids that no float holds, the largest id, repeated ids of other texts, one very long text, clashing columns."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    part = long[100_000:100_300]
    rows = [(2**53, "x " + part), (2**53 + 1, part), (2**63 - 1, part[40:200]), (7, long), (7, part[::-1]), (8, part[::-1])]
    df = spark.createDataFrame([(d, t, d, "k") for d, t in rows], "doc_id long, text string, id long, mask string")
    for hot in (1, 4000):
        out = remove_repeats(df, 50, hot=hot, keep=("id", "mask")).collect()
        assert all(r.id == r.doc_id and r.mask == "k" for r in out)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out)
        assert [r[:4] for r in got] == [(7, 300, 0, 0), (7, len(long), 0, 0), (8, 300, 300, 1), (2**53, 302, 300, 1),
                                        (2**53 + 1, 300, 300, 1), (2**63 - 1, 160, 160, 1)]


def test_copies_of_whole_texts(spark):
    """Texts told beforehand as copies, all, some or none of them, and copies among rows without id or with one id."""
    rows = _texts(9, 20)
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:15])] + [(200 + i, rows[3][1]) for i in range(9)] + [(300, "short")] * 3 + [(301, "short")]
    df = spark.createDataFrame([(d, t, f"k{d}") for d, t in rows], "doc_id long, text string, mark string")
    want = sorted(remove_repeats_by_brute_force(rows))
    for copies in (0, 1, 200_000):
        out = remove_repeats(df, keep=("mark",), copies=copies).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out) == want
        assert all(r.mark == f"k{r.doc_id}" for r in out)
    text = "these are more than fifty bytes of one text that several rows have"
    odd = spark.createDataFrame([(None, text), (None, text), (2**63 - 1, text), (5, None), (6, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(odd).collect()) == [(0, 0), (0, 0), (5, 0), (6, 0), (2**63 - 1, 0)]


def test_anchors_of_many_chunks_in_one_pass():
    """As many anchors of 100 times the chunks take about as long; each chunk's share was found by a look at all before."""
    import time

    import pandas as pd

    from findinglake.llm import suffix_dedup as S

    took, found = [], []
    for n in (30, 3000):
        rnd = np.random.default_rng(4)
        keys = [np.unique(rnd.integers(0, 200_000, 300_000 // n).astype(np.uint64)) for _ in range(n)]
        pdf = pd.DataFrame([(1, c, S.pack_sorted(k), S.pack(np.ones(k.size, np.uint16))) for c, k in enumerate(keys)], columns=["range", "chunk", "keys", "counts"])
        began = time.process_time()
        out = S._shared(pdf, 3).set_index("chunk")
        took.append(time.process_time() - began)
        total = np.bincount(np.concatenate(keys).astype(np.int64))
        for c in (0, n // 2, n - 1):
            k = keys[c]
            t = total[k.astype(np.int64)]
            assert S.unpack_sorted(out.loc[c, "cold"]).tolist() == k[(t > 1) & (t <= 3)].tolist() and S.unpack_sorted(out.loc[c, "hot"]).tolist() == k[t > 3].tolist()
    assert took[1] < 8 * took[0] + 0.3
