import math
from collections import Counter

from findinglake.llm.lm_score import cross_entropy_difference

ROWS = [(1, "the cat sat on the mat the cat"), (2, "The dog sat on a log"), (3, "a log a dog a cat"), (4, ""), (5, None),
        (6, "mat zebra the"), (7, "the cat sat on the mat the cat")]
SCHEMA = "doc_id long, text string"


def _brute(rows, target, size):
    docs = [(d, (t or "").lower().split()) for d, t in rows]
    counts = Counter(w for _, ws in docs for w in ws)
    top = sorted(counts.values(), reverse=True)
    assert len(top) <= size - 1 or top[size - 2] > top[size - 1]  # no tie at the edge
    keep = {w for w, n in counts.items() if len(top) <= size - 1 or n >= top[size - 2]}
    v = len(keep) + 1

    def model(ids):
        pairs, single = Counter(), Counter()
        for d, ws in docs:
            if d in ids:
                seq = [None, *(w if w in keep else "" for w in ws)]
                pairs.update(zip(seq, seq[1:]))
                single.update(seq[1:])
        total = sum(single.values()) + v

        def loss(a, b):
            line = {y: n for (x, y), n in pairs.items() if x == a}
            kinds = max(len(line), 1)
            return -math.log((line.get(b, 0) + kinds * (single[b] + 1) / total) / (sum(line.values()) + kinds))

        return loss

    back, goal = model({d for d, _ in rows}), model(target)
    out = []
    for d, ws in docs:
        seq = [None, *(w if w in keep else "" for w in ws)]
        n = max(1, len(ws))
        out.append((d, len(ws), sum(map(goal, seq, seq[1:])) / n, sum(map(back, seq, seq[1:])) / n))
    return out


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    target = spark.createDataFrame([(1,), (7,), (None,), (99,)], "doc_id long")
    for size in (64, 7):
        got = {r.doc_id: r for r in cross_entropy_difference(docs, target, size).collect()}
        for d, n, t, b in _brute(ROWS, {1, 7}, size):
            r = got[d]
            assert r.n_words == n and abs(r.target_loss - t) < 1e-4 and abs(r.background_loss - b) < 1e-4
            assert abs(r.score - (b - t)) < 2e-4
    assert got[1].score > got[3].score


def test_no_target_and_empty(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    none = spark.createDataFrame([], "doc_id long")
    assert all(r.score == 0 for r in cross_entropy_difference(docs, none).collect())
    assert cross_entropy_difference(docs.limit(0), none).count() == 0


def test_every_word_is_its_own_class(spark):
    # 3,000 words twice each: more than any fixed table holds.  Rows 9001 and 9002 differ in one rare word only.
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(100)] * 2
    rows += [(9001, "w3x7 w3x8"), (9002, "w5x1 w3x8"), (None, "w3x7 w3x8")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    target = spark.createDataFrame([(3,), (None,)], "doc_id long")
    got = {r.doc_id: r for r in cross_entropy_difference(docs, target).collect()}
    for d, n, t, b in _brute(rows, {3}, 1 << 20):
        r = got[d]
        assert r.n_words == n and abs(r.target_loss - t) < 1e-5 and abs(r.background_loss - b) < 1e-5
    assert got[9001].score > got[9002].score and got[None].score == got[9001].score
    cut = cross_entropy_difference(docs, target, chunk_bytes=2000, range_bytes=3000)
    assert {r.doc_id: r for r in cut.collect()} == got
