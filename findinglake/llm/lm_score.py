"""Cross-entropy difference: two bigram models over one vocabulary, a target's and the background's, score documents.

The vocabulary is every word of the documents and one class for words not seen (`vocabulary` cuts it to the most
frequent words and one class for the others).  Bigrams are counted over all documents for the background and over the
target's documents for the target, with the same order, classes and smoothing (matched models).  A document's score is
its per-token loss under the background model minus that under the target model: higher is closer to the target.

Both models are sparse and stay distributed.  A chunk of documents sends its distinct bigrams with both counts to
ranges of bigram hashes and gets the totals back, and whether it is the first with a bigram.  With that it sends
each of its distinct words' counts (as a word, as a previous word, and of the bigrams that begin with it) to ranges of
word hashes, and with those totals it works out its own bigrams' losses.  Chunks, ranges and what moves (one compressed
array for each pair of them) grow with the input; no step holds more than a chunk or a range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import pack, pack_sorted, unpack, unpack_sorted
from .suffix_dedup import _range_of, _split
from .textarrays import _C, blocks, mix, span_hashes, words

_RANGE = 32 << 20  # bytes of text for each range of word hashes
_TARGETS = 2_000_000  # so many ids of target documents are broadcast at most
_FLUSH = 3_000_000  # distinct words a task holds before it passes its counts on
_START, _OTHER = np.uint64(0x8EBC6AF09C88C6E5), np.uint64(0x1D8E4E27C47D1251)  # stand for a text's start, other words


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each word; A-Z lower-cased, words are runs of anything but ASCII white space."""
    buf, s, e, owner = words([t.lower() for t in texts])
    return span_hashes(buf, s, e), owner


def _encode(column: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column]


def vocabulary_of(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the `size` most frequent words of all documents (ties: smaller hash)."""
    ranges = max(4, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // _RANGE)

    def count(batches):
        held = np.empty(0, np.uint64), np.empty(0, np.int64)

        def passed(k, c):
            where = ((k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            rows = [(r, pack_sorted(k[i]), pack(c[i])) for r, i in _split(where)] if k.size else []
            return pd.DataFrame(rows, columns=["range", "keys", "counts"])

        for pdf in batches:
            texts = _encode(pdf["text"])
            for i, j in blocks(texts, 1 << 20):
                k, c = np.unique(word_hashes(texts[i:j])[0], return_counts=True)
                held = _sum(np.append(held[0], k), np.append(held[1], c))
                if held[0].size > _FLUSH:
                    yield passed(*held)
                    held = np.empty(0, np.uint64), np.empty(0, np.int64)
        yield passed(*held)

    def most(pdf: pd.DataFrame) -> pd.DataFrame:
        k, c = _sum(
            np.concatenate([unpack_sorted(x) for x in pdf["keys"]]), np.concatenate([unpack(x, np.int64) for x in pdf["counts"]])
        )
        top = np.lexsort((k, -c))[:size]
        return pd.DataFrame({"key": k[top].view(np.int64), "n": c[top]})

    counts = docs.select("text").mapInPandas(count, "range int, keys binary, counts binary")
    best = counts.groupBy("range").applyInPandas(most, "key long, n long")
    rows = best.orderBy(F.desc("n"), "key").limit(size).collect()  # at most `size` rows: the vocabulary
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def _sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if keys.size == 0:
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(counts[order].astype(np.int64), first)


class _Chunk:
    """The distinct words (and the start of a text) and bigrams of one chunk, both in the order of their hashes."""

    def __init__(self, pdf: pd.DataFrame, known: np.ndarray | None):
        texts = _encode(pdf["text"])
        parts = [(*word_hashes(texts[i:j]), i) for i, j in blocks(texts, 1 << 20)]
        h = np.concatenate([np.empty(0, np.uint64), *(p[0] for p in parts)])
        self.owner = np.concatenate([np.empty(0, np.int64), *(p[1] + p[2] for p in parts)])
        if known is not None:
            h[~np.isin(h, known)] = _OTHER
        before = np.append(_START, h[:-1])[: h.size]
        before[np.append(True, self.owner[1:] != self.owner[:-1])[: h.size]] = _START
        key = mix(mix(before * _C[3] ^ _C[4]) + h * _C[5])
        self.keys, first, self.pair = np.unique(key, return_index=True, return_inverse=True)
        self.words = np.unique(np.append(h, _START))
        self.previous, self.word = np.searchsorted(self.words, before[first]), np.searchsorted(self.words, h[first])
        chosen = self.pair[pdf["target"].to_numpy().astype(bool)[self.owner]]
        self.counts = np.stack([np.bincount(x, minlength=first.size) for x in (self.pair, chosen)])


def _sent(chunk: int, keys: np.ndarray, values: np.ndarray, ranges: int) -> pd.DataFrame:
    """One row for each range of the sorted keys: the keys and their lines of values."""
    rows = [(r, chunk, pack_sorted(keys[i]), pack(values[:, i].ravel())) for r, i in _split(_range_of(keys, ranges))]
    return pd.DataFrame(rows, columns=["range", "chunk", "keys", "values"])


def _totals(pdf: pd.DataFrame, lines: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one range: rows by chunk, and of each key sent its chunk's row, itself, total values and if it is the first."""
    pdf = pdf.sort_values("chunk")
    keys = [unpack_sorted(x) for x in pdf["keys"]]
    values = np.concatenate([unpack(x, np.int64).reshape(lines, -1) for x in pdf["values"]], axis=1)
    owner, k = np.repeat(np.arange(len(keys)), [x.size for x in keys]), np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    new = np.append(True, k[order][1:] != k[order][:-1])
    total, first = np.empty_like(values), np.empty(k.size, bool)
    total[:, order] = np.add.reduceat(values[:, order], np.flatnonzero(new), axis=1)[:, np.cumsum(new) - 1]
    first[order] = new
    return pdf, owner, k, total, first


def _told(pdf: pd.DataFrame, owner: np.ndarray, kind: str, values: np.ndarray) -> pd.DataFrame:
    cut = np.append(0, np.cumsum(np.bincount(owner, minlength=len(pdf))))
    rows = [(b, kind, r, pack(values[:, i:j].ravel())) for b, r, i, j in zip(pdf["chunk"], pdf["range"], cut[:-1], cut[1:])]
    return pd.DataFrame(rows, columns=["chunk", "kind", "range", "values"])


def _pair_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each bigram a chunk sent: both models' counts, and 1 for the first chunk that has it."""
    pdf, owner, _, total, first = _totals(pdf, 2)
    return _told(pdf, owner, "pair", np.vstack([total, first]))


def _word_totals(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each word a chunk sent its totals; the first row has the range's number of words and tokens."""
    pdf, owner, k, total, first = _totals(pdf, 6)
    out = _told(pdf, owner, "word", total)
    real = first & (k != _START) & (k != _OTHER)
    for name, n in (("n_words", real.sum()), ("n_back", total[0, first].sum()), ("n_target", total[1, first].sum())):
        out[name] = np.append(int(n), np.zeros(len(out) - 1, np.int64))
    return out


def _gathered(told: pd.DataFrame, kind: str, lines: int) -> np.ndarray:
    """What came back, in the order of the chunk's sorted keys: ranges are in that order too."""
    rows = told[told["kind"] == kind].sort_values("range")
    return np.concatenate([np.empty((lines, 0), np.int64), *(unpack(x, np.int64).reshape(lines, -1) for x in rows["values"])], axis=1)


def _word_counts(chunk: _Chunk, told: pd.DataFrame) -> np.ndarray:
    """Lines for the chunk's words, background and target each: tokens, tokens that follow it, new bigrams it begins."""
    _, in_target, first = _gathered(told, "pair", 3)
    own = np.stack([first, first * (in_target > 0)])
    of = lambda at, x: np.bincount(at, x, chunk.words.size).astype(np.int64)
    return np.stack([of(at, x) for at, two in ((chunk.word, chunk.counts), (chunk.previous, chunk.counts), (chunk.previous, own)) for x in two])


def _losses(chunk: _Chunk, told: pd.DataFrame) -> np.ndarray:
    """Per-token losses (nats) of the chunk's bigrams under the background and the target.

    Absolute counts are smoothed by the unigram model of the same documents (weight: the number of classes that
    followed), and that by one of each class.  Without target documents both models are the background's.
    """
    pairs, words = _gathered(told, "pair", 3), _gathered(told, "word", 6)
    classes, *tokens = (int(told[c].sum()) for c in ("n_words", "n_back", "n_target"))
    out = []
    for m in (0, 1 if tokens[1] else 0):
        single = (words[m][chunk.word] + 1.0) / (tokens[m] + classes + 1)
        kinds = np.maximum(words[4 + m], 1)[chunk.previous]
        out.append(-np.log((pairs[m] + kinds * single) / (words[2 + m][chunk.previous] + kinds)))
    return np.stack(out)


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, vocabulary: int | None = None, chunk_bytes: int = 5 << 20, range_bytes: int = 8 << 20
) -> DataFrame:
    """Per row: doc_id, n_words, target_loss, background_loss, score (background_loss - target_loss).

    docs: doc_id, text; other columns are not read.  A null or empty text has no words, losses 0 and score 0.
    Repeated rows are counted and scored as often as they occur.  target: a table with the doc_ids of the target's
    documents; ids without document and nulls have no effect.  vocabulary: without it every word is its own class;
    with it the `vocabulary` - 1 most frequent words are, and all others are one.  chunk_bytes, range_bytes: text for
    each chunk of documents and each range of hashes; their numbers follow from the size of the input.
    """
    spark: SparkSession = docs.sparkSession
    known = None if vocabulary is None else spark.sparkContext.broadcast(vocabulary_of(docs, vocabulary - 1))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, ranges = max(least, total // chunk_bytes), max(least, total // range_bytes)
    chosen = target.select("doc_id").where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    # Up to 2 million ids (about 100 MB) stay with the scan of the texts; more are joined by a shuffle of both.
    few = chosen.limit(_TARGETS + 1).count() <= _TARGETS
    chosen = F.broadcast(chosen) if few else chosen
    flagged = docs.select("doc_id", "text").join(chosen, "doc_id", "left").select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text",
        F.coalesce("target", F.lit(False)).alias("target"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    parts = flagged.groupBy("chunk")

    def chunk_of(pdf: pd.DataFrame) -> _Chunk:
        return _Chunk(pdf, None if known is None else known.value)

    def send_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk_of(pdf)
        return _sent(pdf["chunk"].iloc[0], chunk.keys, chunk.counts, ranges)

    def send_words(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=["range", "chunk", "keys", "values"])
        chunk = chunk_of(pdf)
        return _sent(pdf["chunk"].iloc[0], chunk.words, _word_counts(chunk, told), ranges)

    def score(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "no_id", "n_words", "target_loss", "background_loss", "score"]
        if not len(pdf):
            return pd.DataFrame([], columns=names)
        chunk = chunk_of(pdf)
        n = np.bincount(chunk.owner, minlength=len(pdf))
        b, t = (np.bincount(chunk.owner, x[chunk.pair], len(pdf)) / np.maximum(n, 1) for x in _losses(chunk, told))
        columns = (pdf["id"], pdf["no_id"], n, t.round(6), b.round(6), (b - t).round(6))
        return pd.DataFrame(dict(zip(names, columns)))

    sent, back = "range int, chunk int, keys binary, values binary", "chunk int, kind string, range int, values binary"
    pairs = parts.applyInPandas(send_pairs, sent).groupBy("range").applyInPandas(_pair_totals, back)
    words = parts.cogroup(pairs.groupBy("chunk")).applyInPandas(send_words, sent)
    words = words.groupBy("range").applyInPandas(_word_totals, f"{back}, n_words long, n_back long, n_target long")
    # The number of words and both numbers of tokens: one row, told to each chunk.
    sums = words.agg(*(F.sum(c).alias(c) for c in ("n_words", "n_back", "n_target")))
    sums = spark.range(chunks).select(F.col("id").cast("int").alias("chunk"), F.lit("sum").alias("kind")).crossJoin(F.broadcast(sums))
    told = pairs.unionByName(words.drop("n_words", "n_back", "n_target"), allowMissingColumns=True).unionByName(sums, allowMissingColumns=True)
    out = parts.cogroup(told.groupBy("chunk")).applyInPandas(
        score, "id long, no_id boolean, n_words long, target_loss double, background_loss double, score double"
    )
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_words", "target_loss", "background_loss", "score")
