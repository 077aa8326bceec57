"""Memory of Python workers: what a stage takes at once, and what it leaves to the next."""

import tracemalloc

import numpy as np
import pandas as pd

from findinglake.llm import packing, suffix_dedup, toxicity, workers
from findinglake.llm.blobs import pack, pack_bytes, unpack


def _peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _sent(n_docs, n_bytes, chunks=3, letters=4):
    """What chunks of documents with common passages send to one range, and its entries: (chunk, document, bytes)."""
    rnd = np.random.default_rng(5)
    passage = lambda n: bytes(rnd.integers(97, 97 + letters, n).astype(np.uint8)).decode()
    common = [passage(200) for _ in range(n_docs // 4 + 1)]
    rows, entries = [], []
    for b in range(chunks):
        ids = np.arange(b, n_docs, chunks)
        texts = [passage(n_bytes // 2) + common[i] + passage(n_bytes // 2) for i in rnd.integers(0, len(common), ids.size)]
        chunk = suffix_dedup._Chunk(pd.DataFrame({"id": ids, "no_id": False, "text": texts, "chunk": b}), 50)
        for level, _, _, _, _, own, docs, offs, _ in chunk.contexts(np.unique(chunk.key), np.empty(0, np.uint64), 1):
            sizes = np.array([len(x) for x in own], np.uint16)
            rows.append((0, b, level, pack(sizes), pack(offs.astype(np.uint8)), pack(docs), pack_bytes(b"".join(own))))
            entries.append((b, docs, own))
    return pd.DataFrame(rows, columns=["range", "chunk", "level", "sizes", "offsets", "ids", "data"]), entries


def test_a_ranges_parts_give_the_same_marks(monkeypatch):
    pdf, entries = _sent(60, 300)
    first: dict[bytes, int] = {}
    for _, docs, own in entries:
        for d, x in zip(docs.tolist(), own):
            for i in range(len(x) - 49):
                first[x[i : i + 50]] = min(d, first.get(x[i : i + 50], d))
    for part in (300, 5000, 1 << 30):
        monkeypatch.setattr(suffix_dedup, "_PART", part, raising=False)
        got = suffix_dedup._marks(pdf, 50).set_index("chunk")["mask"]
        some = 0
        for b, docs, own in entries:
            for d, x, m in zip(docs.tolist(), own, unpack(got[b], np.uint64).tolist()):
                want = [first[x[i : i + 50]] < d for i in range(len(x) - 49)]
                assert [m >> i & 1 == 1 for i in range(len(want))] == want
                some += sum(want)
        assert some > 1000


def test_a_range_is_not_taken_whole():
    pdf, entries = _sent(600, 3000)
    size = sum(len(x) for _, _, own in entries for x in own) / 1e6
    out, peak = _peak_mb(lambda: suffix_dedup._marks(pdf, 50))
    assert size > 6 and len(out) == 3 and peak < 5 * size


def test_true_values_of_spans():
    mask = np.array([1, 1, 0, 1, 0, 0, 1], bool)
    starts, ends = np.array([0, 2, 2, 5, 7]), np.array([2, 2, 5, 7, 7])
    assert suffix_dedup._true_in(mask, starts, ends).tolist() == [2, 0, 1, 1, 0]
    assert suffix_dedup._true_in(mask[:0], np.array([0]), np.array([0])).tolist() == [0]


def test_other_work_forgets_the_tokenizers_words():
    packing.encoder(packing.default_tokenizer())
    workers.release(keep=packing.encoder)
    assert packing.encoder.cache_info().currsize == 1
    assert workers.lean(lambda x: x + 1)(1) == 2 and workers.lean_pair(lambda x, y: x + y)(1, 2) == 3
    assert packing.encoder.cache_info().currsize == 0


def test_scores_do_not_depend_on_batches(spark):
    """A batch's texts are scored in parts."""
    w = np.zeros((1 << toxicity.BITS) + 1, np.float32)
    w[::3], w[-1] = 0.5, -3
    texts = [None, "", "a word. another one! " * 40, "x" * 700_000, *(f"number {i} of some words\nand more {i * 7}" for i in range(50))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, w).collect()}
    score, found = toxicity.score([(t or "").encode() for t in texts], w)
    assert [got[i].score for i in range(len(texts))] == score.tolist()
    assert [[tuple(x) for x in got[i].sentences] for i in range(len(texts))] == found
    assert any(found)
