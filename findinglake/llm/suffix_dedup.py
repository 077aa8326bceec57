"""Suffix-array removal of repeated byte passages.

Every byte covered by a `length`-byte string that also starts in a document with a smaller id is removed.  In terms
of a longest-previous-factor (LPF) array over the documents in id order, where "previous" means "in a document with
a smaller id", a window start is marked when its LPF is at least `length`.  The LPF of a suffix is the longer common
prefix with its previous or next smaller position in suffix order (the nearest suffixes before and after it that are
of a smaller document), so one sort answers all windows at once.

A suffix array of the whole corpus would ship fifty bytes for each byte of text.  It is built piecewise instead, of texts
without their copies: a text that a smaller id has too goes whole.

1. Each window has an anchor, its smallest hashed 16-byte substring.  Equal windows have equal anchors, so only
   windows whose anchor occurs in two or more documents can be repeated.  Anchors meet by hash range.
2. Consecutive windows with one anchor form a run.  Runs with shared anchors are sent, with their bytes, to the
   range of their anchor; equal runs are folded to their smallest document before they leave a chunk.
3. A range builds the suffix array of its distinct runs (up to `length` bytes; ties by document), the common prefixes
   of neighbours, and from the previous and next smaller documents each suffix's LPF.  Equal runs would be neighbours
   there, so all but that of the smallest document are repeated whole and only that one takes part.  So do only
   suffixes whose `length` bytes hash like another's, as no other can reach a factor of that length.
4. An anchor found in more than `hot` documents, such as a frequent phrase, would bring its many contexts to one range.
   The windows of such anchors are anchored again, by their smallest hashed substring of ten bytes less than a window,
   and take the same way; what shares such an anchor is a repeated passage and folds.

All comparisons are of bytes; hashes only bring together what may be equal.  Chunks, ranges and all tables grow with
the input; no step holds more than a chunk or a range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import pack, pack_bytes, pack_sorted, unpack, unpack_bytes, unpack_sorted
from .tables import cut_lineage
from .textarrays import loads, mix, spans, window_hash
from .workers import lean, lean_pair


_RUNS = 1 << 13  # runs whose windows are listed at a time
_PART = 1 << 20  # bytes of runs that a range compares at a time


def _anchor_size(length: int, level: int = 0) -> int:
    """Bytes of an anchor; no run has more than 64 windows.  Level 1 is for windows whose first anchor is hot."""
    return max(8, length - 10) if level else max(8, min(16, length // 2), length - 62)


def _runs(buf: np.ndarray, ends: np.ndarray, length: int, block: int = 1 << 16):
    """Runs of windows with one anchor: (start, number of windows, anchor start, anchor key)."""
    k = _anchor_size(length)
    w, n = length - k + 1, buf.size - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    valid = np.ones(n, bool)
    lens = np.diff(ends, prepend=0)
    for back in range(1, length):  # windows that would cross a document's end
        at = ends[lens >= back] - back
        valid[at[at < n]] = False
    low = np.uint64((1 << 20) - 1)
    out = []
    for s in range(0, n, block):
        e = min(n, s + block)
        h = window_hash(buf[s : e + length - 1], k)
        v = (h & ~low) | np.arange(h.size, dtype=np.uint64)
        step, m = 1, v
        while step * 2 <= w:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < w:
            m = np.minimum(m[: m.size - (w - step)], m[w - step :])
        at = (m & low).astype(np.int64)
        ok = valid[s:e]
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new)
        if first.size == 0:
            continue
        stop = np.append(first[1:], at.size)
        dead = np.flatnonzero(~ok)
        if dead.size:
            i = np.searchsorted(dead, first)
            stop = np.minimum(stop, np.where(i < dead.size, dead[np.minimum(i, dead.size - 1)], at.size))
        a = at[first]
        out.append((first + s, stop - first, a + s, mix(h[a] ^ np.uint64(0x5DEECE66D))))
    if not out:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out))


def _range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class _Chunk:
    """The documents of one chunk as one buffer, in a fixed order: by id, then text, those without id last."""

    def __init__(self, pdf: pd.DataFrame, length: int):
        self.pdf = pdf = pdf.assign(text=pdf["text"].fillna("")).sort_values(["no_id", "id", "text"], ignore_index=True)
        texts = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
        self.ids, self.length = pdf["id"].to_numpy(), length
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.empty(0, np.int64)
        self.data = b"".join(texts)
        self.buf = np.frombuffer(self.data, np.uint8)
        self.start, self.count, self.anchor, self.key = _runs(self.buf, self.ends, length)
        self.doc = self._doc(self.start)

    def _doc(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.ends, at, "right")] if at.size else at

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor keys and in how many documents of the chunk each occurs."""
        order = np.argsort(self.key, kind="stable")
        k, d = self.key[order], self.doc[order]
        if k.size == 0:
            return k, np.empty(0, np.uint16)
        new = np.append(True, k[1:] != k[:-1])
        fresh = new | np.append(True, d[1:] != d[:-1])
        first = np.flatnonzero(new)
        return k[first], np.minimum(np.add.reduceat(fresh.astype(np.int64), first), 65535).astype(np.uint16)

    def among(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of the runs whose anchor is one of the sorted keys."""
        if keys.size == 0:
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(keys, self.key), keys.size - 1)
        return np.flatnonzero(keys[at] == self.key)

    def _anchored_again(self, runs: np.ndarray) -> tuple[np.ndarray, ...]:
        """The windows of some runs as runs of level 1: start, number, anchor start, anchor key."""
        k = _anchor_size(self.length, 1)
        w, c = self.length - k + 1, self.count[runs]
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        at = np.repeat(self.start[runs], c) + nth
        best, where = np.full(at.size, np.iinfo(np.uint64).max), at.copy()
        for o in range(w):
            h = window_hash(self.buf, k, 4, at + o)
            less = h < best
            best[less], where[less] = h[less], (at + o)[less]
        new = nth == 0
        new[1:] |= where[1:] != where[:-1]
        first = np.flatnonzero(new)
        return at[first], np.diff(np.append(first, at.size)), where[first], mix(best[first] ^ np.uint64(0x5DEECE66D))

    def contexts(self, cold: np.ndarray, hot: np.ndarray, ranges: int):
        """For each level that has any: level, runs' starts, sizes and documents, each run's entry among the distinct
        runs (in a fixed order), and of the entries bytes, smallest ids, anchor offsets and ranges."""
        some = self.among(cold)
        runs = [(0, self.start[some], self.count[some], self.anchor[some], self.key[some])]
        runs.append((1, *self._anchored_again(self.among(hot))))
        data, size = self.data, self.length - 1
        for level, start, count, anchor, key in runs:
            if not start.size:
                continue
            seen: dict[bytes, int] = {}
            entry, first = np.empty(start.size, np.int64), []
            for i, (s, c) in enumerate(zip(start.tolist(), count.tolist())):
                x = data[s : s + c + size]
                e = seen.get(x)
                if e is None:
                    e = seen[x] = len(seen)
                    first.append(i)
                entry[i] = e
            doc, f = self._doc(start), np.array(first, np.int64)
            yield level, start, count, doc, entry, list(seen), doc[f], (anchor - start)[f], _range_of(key[f], ranges)


def _true_in(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many values are true in each of the spans, which lie side by side and together are the mask."""
    out, some = np.zeros(starts.size, np.int64), ends > starts
    if some.any():
        out[some] = np.add.reduceat(mask, starts[some], dtype=np.int64)
    return out


def _split(ranges: np.ndarray):
    """(range, indexes in given order) for each range that occurs."""
    order = np.argsort(ranges, kind="stable")
    cut = np.flatnonzero(np.diff(ranges[order])) + 1
    for part in np.split(order, cut):
        if part.size:
            yield int(ranges[part[0]]), part


def _smaller_before(doc: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each suffix the common prefix with the nearest suffix before it that is of a smaller document, or 0.

    lcp: the common prefix of each suffix with the one before it (0 for the first).  Every suffix points at one before
    it, with only documents not smaller than its own between; while that one isn't smaller either, it takes over that
    one's pointer, so pointers double their reach in each round.
    """
    at, lcp = np.arange(doc.size) - 1, lcp.copy()
    open_ = np.flatnonzero(lcp > 0)
    while True:
        open_ = open_[(lcp[open_] > 0)]
        open_ = open_[doc[at[open_]] >= doc[open_]]
        if not open_.size:
            return lcp
        to = at[open_]
        less, further = np.minimum(lcp[open_], lcp[to]), at[to]
        lcp[open_], at[open_] = less, further


def lpf_array(buf: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """The longest previous factor, up to `length` bytes, of each suffix of buf that starts at `at`.

    Each suffix has `length` bytes; a factor is previous when its document is smaller.  The suffixes are sorted by
    these bytes and, where they are equal, by document.
    """
    if not at.size:
        return np.empty(0, np.int64)
    u = loads(buf, big=True)
    offsets = [*range(0, length - 8, 8), length - 8]
    keys = [u[at + o].astype(np.uint64) for o in offsets]
    order = np.lexsort((doc, *keys[::-1]))
    lcp = np.full(at.size, length, np.int64)
    for o, k in zip(offsets[::-1], keys[::-1]):  # the first difference counts, so it is set last
        k = k[order]
        x = np.append(np.uint64(0), k[1:] ^ k[:-1])
        differ = np.flatnonzero(x)
        lcp[differ] = o + sum((x[differ] < np.uint64(1 << (64 - 8 * n))).astype(np.int64) for n in range(1, 8))
    lcp[0] = 0
    doc = doc[order]
    back = np.append(0, lcp[:0:-1])
    out = np.empty(at.size, np.int64)
    out[order] = np.maximum(_smaller_before(doc, lcp), _smaller_before(doc[::-1], back)[::-1])
    return out


def _shared(pdf: pd.DataFrame, hot: int) -> pd.DataFrame:
    """Of one range: the anchors that occur in two or more documents, told to each chunk that has them."""
    pdf = pdf.sort_values("chunk")
    keys = [unpack_sorted(x) for x in pdf["keys"]]
    counts = [unpack(x, np.uint16) for x in pdf["counts"]]
    k, c = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(k, kind="stable")
    first = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
    total = np.empty(k.size, np.int64)
    total[order] = np.repeat(np.add.reduceat(c[order], first), np.diff(np.append(first, k.size)))
    rows, at = [], 0
    for b, own in zip(pdf["chunk"], keys):  # each chunk's keys lie side by side
        n = total[at : at + own.size]
        at += own.size
        cold, many = own[(n > 1) & (n <= hot)], own[n > hot]
        if cold.size or many.size:
            rows.append((b, pack_sorted(cold), pack_sorted(many)))
    return pd.DataFrame(rows, columns=["chunk", "cold", "hot"])


def _marks(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Of one range: for each entry a chunk sent, which of its windows its smallest document repeats."""
    rows = []
    for level, runs in pdf.sort_values("chunk").groupby("level"):
        k = _anchor_size(length, int(level))
        own = [unpack(x, np.uint16) for x in runs["sizes"]]
        sizes = np.concatenate(own).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        offs = np.concatenate([unpack(x, np.uint8) for x in runs["offsets"]]).astype(np.int64)
        ids = np.concatenate([unpack(x, np.int64) for x in runs["ids"]])
        data = b"".join(unpack_bytes(x) for x in runs["data"])
        mask = np.zeros(ids.size, np.uint64)
        # Only runs of one anchor can share a window, so runs are taken in parts by a hash of their anchor's bytes.
        key = window_hash(np.frombuffer(data, np.uint8), k, 6, starts + offs)
        for _, part in _split(_range_of(key, -(-len(data) // _PART))):
            mask[part] = _marks_of(data, *(x[part] for x in (starts, sizes, offs, ids)), length, k)
        ends = np.cumsum([x.size for x in own])
        for b, e, x in zip(runs["chunk"], ends.tolist(), own):
            rows.append((b, int(level), pack(mask[e - x.size : e])))
    return pd.DataFrame(rows, columns=["chunk", "level", "mask"]).assign(range=pdf["range"].iloc[0])


def _marks_of(data: bytes, starts: np.ndarray, sizes: np.ndarray, offs: np.ndarray, ids: np.ndarray, length: int, k: int) -> np.ndarray:
    """The masks of some entries, of which are given starts and sizes in data, anchor offsets and documents; k: the
    anchor's bytes."""
    seen: dict[bytes, int] = {}
    entry = np.array([seen.setdefault(data[s:e], len(seen)) for s, e in zip(starts.tolist(), (starts + sizes).tolist())], np.int64)
    first = np.flatnonzero(np.diff(np.maximum.accumulate(entry), prepend=-1))  # entries are numbered as they come
    doc = np.full(first.size, np.iinfo(np.int64).max)
    np.minimum.at(doc, entry, ids)
    groups: dict[bytes, int] = {}
    anchors = starts[first] + offs[first]
    group = np.array([groups.setdefault(data[s : s + k], len(groups)) for s in anchors.tolist()], np.int64)
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    mask = np.zeros(first.size, np.uint64)
    if several.size:
        buf, c = np.frombuffer(data, np.uint8), sizes[first[several]] - length + 1
        nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        at, run = np.repeat(starts[first[several]], c) + nth, np.repeat(several, c)
        h = window_hash(buf, length, 2, at)
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        some = order[np.append(False, same) | np.append(same, False)]
        hit = some[lpf_array(buf, at[some], doc[run[some]], length) >= length]
        np.bitwise_or.at(mask, run[hit], np.uint64(1) << nth[hit].astype(np.uint64))
    return np.where(doc[entry] < ids, ~np.uint64(0), mask[entry])


def _copies(rows: DataFrame, length: int, most: int) -> DataFrame:
    """text_key (SHA-256), first (the smallest id), n and size of texts that have several ids, the `most` most frequent.

    Whichever copies are found here needn't be compared later on; the result is the same without them.
    """
    size = F.octet_length("text")
    found = rows.where(size >= length).groupBy(F.unhex(F.sha2("text", 256)).alias("text_key")).agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"), F.max(size).cast("long").alias("size")
    )
    return cut_lineage(found.where("first < last").drop("last").orderBy(F.desc("n"), "text_key").limit(most))


def remove_repeats(
    docs: DataFrame,
    length: int = 50,
    hot: int = 4000,
    chunk_bytes: int = 6 << 20,
    range_bytes: int = 12 << 20,
    keep: tuple[str, ...] = (),
    copies: int = 200_000,
) -> DataFrame:
    """Removes repeated passages; returns doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) and `keep`.

    One row per input row.  Texts are UTF-8; a null text is empty.  Documents with equal ids (repeated rows) are
    not earlier than each other, so neither loses bytes to the other.  A document without id stands beside the largest
    id there can be, after all others: no other loses bytes to it.  Columns other than doc_id, text and those named in keep (which must not be
    called like a result) are not read.

    hot: anchors of more documents than this are divided; copies: that many texts at most, which have several ids, are
    told to all tasks beforehand; the result is the same with any number.  chunk_bytes, range_bytes: text for each
    chunk of documents and each range of anchors; their numbers follow from the size of the input.
    """
    spark: SparkSession = docs.sparkSession
    types = dict(docs.dtypes)
    names = {f"keep{i}": c for i, c in enumerate(keep)}  # no clash with columns of the operator's own
    rows = docs.select(
        F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text",
        *(F.col(c).alias(n) for n, c in names.items()),
    )
    known_copies = _copies(rows.select("id", "text"), length, copies)
    again = known_copies.agg(F.sum((F.col("n") - 1) * F.col("size"))).first()[0] or 0
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) - again
    if again:
        rows = rows.withColumn("text_key", F.unhex(F.sha2("text", 256))).join(F.broadcast(known_copies.select("text_key", "first")), "text_key", "left")
    is_copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)) if again else F.lit(False)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, ranges = max(least, total // chunk_bytes), max(least, total // range_bytes)
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    parts = rows.where(~is_copy).select("id", "no_id", "text", chunk, *names).groupBy("chunk")

    def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _Chunk(pdf, length).anchors()
        b = pdf["chunk"].iloc[0]
        return pd.DataFrame(
            [(r, b, pack_sorted(keys[i]), pack(counts[i])) for r, i in _split(_range_of(keys, ranges))],
            columns=["range", "chunk", "keys", "counts"],
        )

    def known(told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return tuple(
            np.sort(np.concatenate([np.empty(0, np.uint64), *map(unpack_sorted, told[c])])) for c in ("cold", "hot")
        )

    def entries(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(pdf) and len(told):
            b = int(pdf["chunk"].iloc[0])
            for level, _, _, _, _, texts, ids, offs, rng in _Chunk(pdf, length).contexts(*known(told), ranges):
                for r, i in _split(rng):
                    own = [texts[j] for j in i.tolist()]
                    sizes = np.array([len(x) for x in own], np.uint16)
                    rows.append((r, b, level, pack(sizes), pack(offs[i].astype(np.uint8)), pack(ids[i]), pack_bytes(b"".join(own))))
        return pd.DataFrame(rows, columns=["range", "chunk", "level", "sizes", "offsets", "ids", "data"])

    def cut(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "no_id", "n_bytes", "n_removed", "n_spans", "kept"]
        if not len(pdf):
            return pd.DataFrame([], columns=[*columns, *names])
        chunk = _Chunk(pdf, length)
        mark = np.zeros(chunk.buf.size + 1, np.int32)
        masks = {(k, r): m for k, r, m in zip(told["level"], told["range"], told["mask"]) if m is not None}
        for level, start, count, doc, entry, _, ids, _, rng in chunk.contexts(*known(told[told["level"] < 0]), ranges):
            m = np.zeros(rng.size, np.uint64)
            for r, i in _split(rng):
                m[i] = unpack(masks[level, r], np.uint64)
            m = m[entry]
            m[doc > ids[entry]] = ~np.uint64(0)
            runs = np.flatnonzero(m)
            for part in np.split(runs, range(_RUNS, runs.size, _RUNS)):
                c = count[part]
                nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                hit = (np.repeat(m[part], c) >> nth.astype(np.uint64)) & np.uint64(1) == 1
                at = (np.repeat(start[part], c) + nth)[hit]
                np.add.at(mark, at, 1)
                np.add.at(mark, at + length, -1)
        np.cumsum(mark, out=mark)
        gone = mark[:-1] > 0
        del mark
        starts = np.append(0, chunk.ends[:-1])
        begun = gone.copy()
        begun[1:] &= ~gone[:-1]
        inner = starts[(starts < gone.size) & (chunk.ends > starts)]
        begun[inner] = gone[inner]  # a removed run ends with its document
        sizes, lost, new = chunk.ends - starts, _true_in(gone, starts, chunk.ends), _true_in(begun, starts, chunk.ends)
        rest = chunk.buf[~gone].tobytes()
        left = np.cumsum(sizes - lost)
        rows = [
            (d, no, n, gone_, runs, rest[e - (n - gone_) : e])
            for d, no, n, gone_, runs, e in zip(chunk.ids.tolist(), chunk.pdf["no_id"].tolist(), *(x.tolist() for x in (sizes, lost, new, left)))
        ]
        return pd.concat([pd.DataFrame(rows, columns=columns), chunk.pdf[list(names)]], axis=1)

    shared = (
        parts.applyInPandas(lean(anchors), "range int, chunk int, keys binary, counts binary")
        .groupBy("range")
        .applyInPandas(lean(lambda pdf: _shared(pdf, hot)), "chunk int, cold binary, hot binary")
    )
    marks = (
        parts.cogroup(shared.groupBy("chunk"))
        .applyInPandas(lean_pair(entries), "range int, chunk int, level int, sizes binary, offsets binary, ids binary, data binary")
        .groupBy("range")
        .applyInPandas(lean(lambda pdf: _marks(pdf, length)), "chunk int, level int, mask binary, range int")
    )
    told = marks.unionByName(shared.withColumn("level", F.lit(-1)), allowMissingColumns=True)
    kept = ", ".join(f"`{n}` {types[c]}" for n, c in names.items())
    out = parts.cogroup(told.groupBy("chunk")).applyInPandas(
        lean_pair(cut), "id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept binary" + (kept and f", {kept}")
    )
    if again:
        size = F.octet_length("text").cast("long")
        whole = rows.where(is_copy).select("id", "no_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"), *names)
        out = out.unionByName(whole)
    doc_id = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    return out.select(doc_id, "n_bytes", "n_removed", "n_spans", "kept", *(F.col(n).alias(c) for n, c in names.items()))


def repeats_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats_by_brute_force(rows: list[tuple[int, str | None]], length: int = 50) -> list[tuple]:
    """The same by definition, in memory; for tests."""
    first: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, t in data:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), len(spans(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out
