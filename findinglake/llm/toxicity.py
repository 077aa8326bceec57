"""Toxicity by multiple-instance learning: sentences are scored, documents carry the labels.

A sentence has the score s = b + sum of the weights of its features and the probability sigmoid(s); a document is
toxic if any of its sentences is (noisy-or): p = 1 - prod(1 - sigmoid(s)).  The weights are learned from document
labels only, by the gradient of the document's log-likelihood, so the sentences that carry the blame get the weight
and can be located afterwards.

Features are the words of a sentence and their prefixes, hashed; labels, language, source and id are none of them.
The model is fitted on at most `bound` labelled documents of each class, chosen by a hash of doc_id among those of at
most `longest` bytes, each class weighted to its share of all labelled rows.  Everything else reads all rows and
whole texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import _TABLE, blocks, mix, span_hashes, spans, text_parts
from .workers import lean, release

BITS = 18
_PREFIXES = (4, 5, 6, 7, 8)
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True
_WORD = np.zeros(256, bool)
_WORD[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of some texts: (features by word, sentence of each word, document, sentence spans).

    Texts are lower-cased in A-Z; a word is a run of digits, letters and bytes over 127; a sentence ends at
    . ! ? or a line end, or with its text.  Sentences without words are left out.
    """
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined.lower(), np.uint8)
    s, e = spans(_WORD[buf])
    ends = np.flatnonzero(_END[buf])
    sentence = np.searchsorted(ends, s)
    used, sentence = np.unique(sentence, return_inverse=True)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(bounds, ends[used], "right")
    begin = np.append(0, ends + 1)[used]
    n = e - s
    out = np.empty((len(_PREFIXES) + 1, s.size), np.int32)
    h = np.zeros(s.size, np.uint64)
    limit = buf.size - 1
    shift = np.uint64(64 - BITS)
    for size in range(1, _PREFIXES[-1] + 1):  # of a shorter word, its prefixes are itself
        step = _TABLE[buf[np.minimum(s + size - 1, limit)]]
        h = np.where(n >= size, (h ^ step) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size), h)
        if size in _PREFIXES:
            out[_PREFIXES.index(size)] = (mix(h ^ np.uint64(0xABCD)) >> shift).astype(np.int32)
    out[-1] = (span_hashes(buf, s, e) >> shift).astype(np.int32)
    return out.T, sentence, doc, np.stack([begin, ends[used]])


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _telling(parts: list, size: int, least: float) -> np.ndarray:
    """Features that toxic documents hold clearly more often than others: excess over chance in standard deviations."""
    seen = np.zeros((2, size))
    total = np.zeros(2)
    for f, sentence, doc, y, c in parts:
        key = np.unique(doc[sentence][:, None] * size + f)
        d, i = key // size, key % size
        for k in (0, 1):
            own = (y > 0) == k
            seen[k] += np.bincount(i[own[d]], c[d][own[d]], size)
            total[k] += c[own].sum()
    chance = (seen[0] + 1) * total[1] / max(total[0], 1e-9)
    return (seen[1] - chance) / np.sqrt(chance + 1e-9 + 0.02 * total[1] / max(1, total.sum())) >= least


def fit(
    texts: list[bytes], toxic: np.ndarray, weight: np.ndarray, epochs: int = 40, batch: int = 64, least: float = 5.0
) -> np.ndarray:
    """Weights and, last, the bias; Adagrad over the noisy-or log-likelihood, the same for the same rows.

    Only features with a clear excess in toxic documents are learned (`least` standard deviations); the rest, most of
    them words of one document, keep the weight 0, or each document would be explained by words of its own.
    """
    size = 1 << BITS
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-2)
    w[size] = -6
    order = np.random.default_rng(7).permutation(len(texts))
    parts = []
    for i in range(0, len(order), batch):
        pick = order[i : i + batch]
        f, sentence, doc, _ = features([texts[j] for j in pick])
        parts.append((f, sentence, doc, toxic[pick], weight[pick]))
    use = _telling(parts, size, least)
    rows = []
    for f, sentence, doc, y, c in parts:
        live = use[f]
        at, col = np.nonzero(live)
        rows.append((f[at, col], sentence[at], doc, y, c))
    for epoch in range(epochs):
        rate = 0.5 / (1 + 0.1 * epoch)
        for f, sentence, doc, y, c in rows:
            if not doc.size:
                continue
            s = w[size] + np.bincount(sentence, w[f], doc.size)
            q = _sigmoid(s)
            rest = np.exp(-np.bincount(doc, _softplus(s), y.size))
            p = np.clip(1 - rest, 1e-6, 1)
            per = q * (np.where(y > 0, -(rest / p), 1.0) * c)[doc]
            at, inverse = np.unique(f, return_inverse=True)
            g = np.append(np.bincount(inverse, per[sentence], at.size) + 2e-3 * w[at], per.sum())
            at = np.append(at, size)
            g2[at] += g * g
            w[at] -= rate * g / np.sqrt(g2[at])
    return w.astype(np.float32)


def score(texts: list[bytes], w: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Per text: the probability, and the byte spans of sentences that are toxic on their own (0.5 or more)."""
    out, found = np.zeros(len(texts)), [[] for _ in texts]
    size = w.size - 1
    for i, j in blocks(texts, 1 << 18):
        f, sentence, doc, at = features(texts[i:j])
        if not sentence.size:
            continue
        s = w[size] + np.bincount(sentence, w[f].sum(1), doc.size)
        out[i:j] = -np.expm1(-np.bincount(doc, _softplus(s), j - i))
        starts = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        for k in np.flatnonzero(s >= 0):
            found[i + doc[k]].append((int(at[0, k] - starts[doc[k]]), int(at[1, k] - starts[doc[k]])))
    return np.clip(out, 0, 1), found


def train(docs: DataFrame, labels: DataFrame, bound: int = 2500, longest: int = 1 << 16) -> np.ndarray:
    """The fitted weights; all zero with a bias that gives 0 if either class is missing.

    labels: doc_id, toxic; several labels of a document count as toxic if one of them is; null labels don't count.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    none = np.zeros((1 << BITS) + 1, np.float32)
    none[-1] = -40
    if len(counts) < 2:
        return none
    share = F.when(F.col("y") == 1, bound / counts[1]).otherwise(bound / counts[0])
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 40)) < share * (1 << 40))
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(sample), "doc_id")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        y = pdf["y"].to_numpy().astype(float)
        have = {k: max(1, int((y == k).sum())) for k in (0, 1)}
        c = np.where(y > 0, counts[1] / have[1], counts[0] / have[0])
        w = fit([t.encode("utf-8", "surrogatepass") for t in pdf["text"]], y, c / c.mean())
        return pd.DataFrame({"w": [w.tobytes()]})

    out = rows.withColumn("fit", F.lit(0)).groupBy("fit").applyInPandas(lean(one), "w binary").collect()
    return np.frombuffer(out[0].w, np.float32) if out else none


def score_documents(docs: DataFrame, w: np.ndarray) -> DataFrame:
    """docs with score (double) and sentences (array of the byte spans that are toxic on their own).

    A null or empty text scores 0.  One row per input row; no shuffle.  Columns of docs named score or sentences are
    replaced.
    """
    import pyarrow as pa

    docs = docs.drop("score", "sentences")
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("sentences")).schema
    at = docs.columns.index("text")
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        release()
        for batch in batches:  # the other columns pass through as they are
            parts = [score(texts, w) for texts in text_parts(batch.column(at))]
            p = np.concatenate([np.empty(0), *(p for p, _ in parts)])
            found = pa.array([[{"start": a, "end": b} for a, b in x] for _, s in parts for x in s], spans_type)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), found], names=[*batch.schema.names, "score", "sentences"])
            release()

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = 2500) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, and how many sentences are toxic on their own."""
    out = score_documents(docs.select("doc_id", "text"), train(docs, labels, bound))
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.size("sentences").alias("n_toxic_sentences"),
    )


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
