"""Quality rules: fixed limits on counts, then robust multivariate outliers per language and source.

The statistics of a document are transformed to a short vector.  For every (lang, source), location and scatter come
from the minimum covariance determinant (MCD): of the subsets of three quarters of the rows, the one whose covariance
has the smallest determinant.  It is searched from several starts made of all rows (medians and median deviations; the
covariance of directions from the median; the ordinary covariance) by concentration steps, each of which takes the rows
nearest to the present estimate; a step never raises the determinant, and steps go on until it stops falling.  The start
with the smallest determinant wins.  A document is rejected if the squared Mahalanobis distance from its group exceeds
the chi-square quantile that one clean document in `1 / tail` passes.

Vectors are packed once into blocks of rows of one group.  A step is two passes over the blocks: a histogram of
distances, in bins of 1/128 of a doubling, and sums of products over the rows below the bin that completes the three
quarters, while that bin's rows share the remaining places.  Every row of a group takes part; a group of any size is
in many blocks.  Sums are of whole numbers, so nothing depends on their order.  Groups of fewer than `least` rows, too
few for 27 parameters, take their language's estimate, and small languages that of all documents.

What a step keeps of a group is small, so a few hundred groups' histograms and sums are one partition, which windows and
joins take without a shuffle: the driver keeps what it knows of each task, and steps of empty ones would fill its memory.

Variances have floors, since most clean documents share one value (no symbols, no repeated lines); without them any
document with one symbol would be an outlier.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage
from .textarrays import _C, blocks, mix, shingles, span_hashes, text_parts, words
from .workers import release

# Smallest standard deviation of each component of the vector.
FLOORS = (0.5, 0.06, 0.4, 0.4, 0.11, 0.16)
TAIL = 1e-6
_DIM = len(FLOORS)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i, _DIM)]
_SCALE = 1 << 16  # fixed point of the sums
_FEW = 20_000  # so many estimates are broadcast at most
_KEYS = 200  # keys whose histograms and estimates are one partition; a histogram has some thousand bins
_BLOCKS = 16  # blocks (3 MB) for each task
_GRID = 128  # histogram bins per unit (medians) and per doubling (distances)
_SYMBOL, _UPPER, _SHOUT = (np.zeros(256, bool) for _ in range(3))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[0x41:0x5B] = True
_SHOUT[list(b"!?")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_shout", "n_lines"]


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x and x.split()]
    return len(lines) - len(set(lines)), len(lines)


def count_texts(texts: list[bytes]) -> np.ndarray:
    """The columns COUNTS of some texts, one row each."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for i, j in blocks(texts):
        n = j - i
        buf, s, e, owner = words(texts[i:j])
        out[i:j, 0] = np.bincount(owner, minlength=n)
        heads = np.append(0, np.cumsum((buf & 0xC0) != 0x80))
        out[i:j, 1] = np.bincount(owner, heads[e] - heads[s], n)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        for col, table in ((2, _SYMBOL), (5, _UPPER), (6, _SHOUT)):
            out[i:j, col] = np.diff(np.append(0, np.cumsum(table[buf]))[bounds])
        out[i:j, [3, 7]] = [_dup_lines(t) for t in texts[i:j]]
        h, who = shingles(span_hashes(buf, s, e), owner, 3)
        if h.size:
            first = np.flatnonzero(owner[: owner.size - 2] == owner[2:])
            key = mix(h ^ (who.astype(np.uint64) * _C[5]))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            dup = np.zeros(key.size, bool)
            dup[order[1:][same]] = True
            dup[order[:-1][same]] = True
            hit = np.zeros(owner.size, bool)
            at = first[dup]
            hit[at] = hit[at + 1] = hit[at + 2] = True
            out[i:j, 4] = np.bincount(owner[hit], minlength=n)
    return out


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash (of 64 bits) and COUNTS of every whole text; a null text counts as empty.  No shuffle.

    An Arrow batch's texts are taken out half a megabyte at a time (one text at least), so a worker holds little besides
    the batch itself, whatever its number of rows.
    """
    import pyarrow as pa

    def run(batches):
        release()
        for batch in batches:
            parts = [count_texts(texts) for texts in text_parts(batch.column(batch.num_columns - 1))]
            n = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            columns = [*batch.columns[:-1], *(pa.array(n[:, k]) for k in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *COUNTS])
            release()

    id_ = F.coalesce("doc_id", F.lit(0)).cast("long").alias("id")
    out = docs.select(id_, F.col("doc_id").isNull().alias("no_id"), "lang", "source", F.xxhash64("text").alias("text_hash"), "text")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    out = out.mapInArrow(run, f"id long, no_id boolean, lang string, source string, text_hash long, {counts}")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "lang", "source", "text_hash", *COUNTS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> Column:
    w, c, lines = (F.greatest(F.col(x), F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    return F.array(
        F.log1p(100 * F.col("n_symbols") / w),
        F.log(c / w),
        F.log1p(100 * F.col("n_upper") / c),
        F.log1p(100 * F.col("n_shout") / w),
        F.sqrt(F.col("n_repeat_words") / w),
        F.sqrt(F.col("n_dup_lines") / lines),
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of v: the row-major inverse of the scatter times the deviation, twice."""
    d = [F.col("v")[i] - F.col("center")[i] for i in range(_DIM)]
    return sum(d[i] * d[j] * F.col("inverse")[i * _DIM + j] for i in range(_DIM) for j in range(_DIM))


def blocks_of(vectors: DataFrame, size: int = 4_000) -> DataFrame:
    """(key, v, deal) packed: key, n and the vectors of a block of about `size` rows of the key, in any order.

    deal: a number of the row, fixed where the rows were written; rows without it are numbered here.
    """
    if "deal" not in vectors.columns:
        vectors = cut_lineage(vectors).withColumn("deal", F.monotonically_increasing_id())
    counts = vectors.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    counts = cut_lineage(counts)
    n, parts = counts.agg(F.count("*"), F.sum("parts")).first()
    counts = F.broadcast(counts) if n <= _FEW else counts
    # Rows are dealt by numbers that they were given before the join, so a repeated task deals them alike.
    dealt = vectors.join(counts, "key").withColumn("part", F.pmod(F.xxhash64("v", "deal"), F.col("parts")).cast("int"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [len(x)], "data": [x.tobytes()]})

    packed = cut_lineage(dealt.select("key", "part", "v").groupBy("key", "part").applyInPandas(one, "key string, n long, data binary"))
    return packed.coalesce(8 + (parts or 0) // _BLOCKS)


def _held(df: DataFrame, tasks: int | None) -> DataFrame:
    """A table of a few rows for each key in so many partitions; None: as it is."""
    return df.coalesce(tasks) if tasks else df


def _over(blocks: DataFrame, told: DataFrame | None, tasks: int | None, run, schema: str) -> DataFrame:
    """run(vectors, row) -> rows, for each block and each row of `told` with its key; tasks: None if keys are too many to broadcast."""
    if told is not None:
        blocks = blocks.join(F.broadcast(told) if tasks else told, "key")

    def each(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = run(np.frombuffer(row.data, np.float64).reshape(-1, _DIM), row)
                if out:
                    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in schema.split(", ")])

    return blocks.mapInPandas(each, schema)


def _fixed(x: np.ndarray) -> list[int]:
    """Sums of the components and of their products, in fixed point."""
    v = np.rint(x * _SCALE).astype(np.int64)
    return [*v.sum(0).tolist(), *(int((v[:, i] * v[:, j] >> 16).sum()) for i, j in _PAIRS)]


_SUMS = [f"s{i}" for i in range(_DIM + len(_PAIRS))]


def _moments(sums, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from fixed-point sums over n rows."""
    mean = np.array(sums[:_DIM], np.float64) / _SCALE / n
    cov = np.zeros((_DIM, _DIM))
    for (i, j), x in zip(_PAIRS, sums[_DIM:]):
        cov[i, j] = cov[j, i] = x / _SCALE / n - mean[i] * mean[j]
    return mean, cov


def _estimate(mean: np.ndarray, cov: np.ndarray, factor: float = 1.0) -> tuple[list, list, float]:
    """center, inverse and the logarithm of the determinant; variances have floors, and the result can be inverted."""
    cov = cov * factor
    cov = cov + np.diag(np.maximum(np.array(FLOORS) ** 2 - np.diag(cov), 0))
    low, axes = np.linalg.eigh((cov + cov.T) / 2)
    low = np.maximum(low, 1e-6 * np.array(FLOORS).min() ** 2)
    return mean.tolist(), ((axes / low) @ axes.T).ravel().tolist(), float(np.log(low).sum())


def _medians(hist: DataFrame, tasks: int | None) -> DataFrame:
    """Of a histogram (key, dim, bin, n): key, mid (the median of each component, on the grid) and the key's rows."""
    w = F.expr("sum(n) over (partition by key, dim order by bin)")
    total = F.expr("sum(n) over (partition by key, dim)")
    reached = _held(hist.groupBy("key", "dim", "bin").agg(F.sum("n").alias("n")), tasks).withColumns({"upto": w, "total": total})
    mid = reached.where(2 * F.col("upto") >= F.col("total")).groupBy("key", "dim").agg(F.min("bin").alias("bin"), F.max("total").alias("total"))
    place = F.array_sort(F.collect_list(F.struct("dim", (F.col("bin") / _GRID).alias("x"))))["x"]
    return mid.groupBy("key").agg(place.alias("mid"), F.max("total").alias("rows"))


def _histogram(key: str, x: np.ndarray) -> list[tuple]:
    out = []
    for d in range(_DIM):
        bins, n = np.unique(np.rint(x[:, d] * _GRID).astype(np.int64), return_counts=True)
        out += [(key, d, b, c) for b, c in zip(bins.tolist(), n.tolist())]
    return out


def _starts(blocks: DataFrame, tasks: int | None) -> DataFrame:
    """key, rows, start, center, inverse of three starts for each key; medians and deviations are on the grid."""
    schema = "key string, dim int, bin long, n long"
    mid = _held(cut_lineage(_medians(_over(blocks, None, tasks, lambda x, r: _histogram(r.key, x), schema), tasks)), tasks)
    away = _medians(_over(blocks, mid, tasks, lambda x, r: _histogram(r.key, np.abs(x - np.array(r.mid))), schema), tasks)
    known = _held(cut_lineage(mid.join(away.select("key", F.col("mid").alias("mad")), "key")), tasks)
    spread = lambda mad: np.maximum(np.array(mad) * 1.4826, FLOORS)

    def sums(x, r):
        z = (x - np.array(r.mid)) / spread(r.mad)
        length = np.linalg.norm(z, axis=1, keepdims=True)
        return [(r.key, "all", *_fixed(x)), (r.key, "signs", *_fixed(z / np.maximum(length, 1e-9)))]

    total = _over(blocks, known, tasks, sums, "key string, kind string, " + ", ".join(f"{c} long" for c in _SUMS))
    total = _held(total.groupBy("key", "kind").agg(*(F.sum(c).alias(c) for c in _SUMS)), tasks).join(known, "key")

    def made(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                mean, cov = _moments([getattr(r, c) for c in _SUMS], r.rows)
                scale, mid = spread(r.mad), np.array(r.mid)
                if r.kind == "all":
                    rows.append((r.key, r.rows, 0, *_estimate(mid, np.diag(scale**2))))
                    rows.append((r.key, r.rows, 1, *_estimate(mean, cov)))
                else:
                    rows.append((r.key, r.rows, 2, *_estimate(mid, _DIM * (cov + np.outer(mean, mean)) * np.outer(scale, scale))))
            yield pd.DataFrame(rows, columns=["key", "rows", "start", "center", "inverse", "log_det"])

    return total.mapInPandas(made, _ESTIMATE)


_ESTIMATE = "key string, rows long, start int, center array<double>, inverse array<double>, log_det double"


def _concentrated(blocks: DataFrame, now: DataFrame, tasks: int | None, share: float, factor: float) -> DataFrame:
    """One step: the estimates of the `share` of rows nearest to each present one."""
    now = _held(now, tasks)

    def bins(x, r):
        d = x - np.array(r.center)
        d = np.einsum("ij,jk,ik->i", d, np.array(r.inverse).reshape(_DIM, _DIM), d)
        return np.floor(np.log2(np.maximum(d, 0) + 1e-3) * _GRID).astype(np.int64)

    def count(x, r):
        return [(r.key, r.start, b, c) for b, c in zip(*(y.tolist() for y in np.unique(bins(x, r), return_counts=True)))]

    hist = _over(blocks, now, tasks, count, "key string, start int, bin long, n long").groupBy("key", "start", "bin").agg(F.sum("n").alias("n"))
    hist = _held(hist, tasks)
    upto = F.expr("sum(n) over (partition by key, start order by bin)")
    edge = hist.withColumn("upto", upto).join(now.select("key", "start", F.ceil(F.col("rows") * share).alias("h")), ["key", "start"])
    edge = edge.where("upto >= h").groupBy("key", "start").agg(F.min(F.struct("bin", "n", "upto")).alias("x"), F.max("h").alias("h"))
    # The rows of the last bin have an equal share each of the places that are left.
    edge = edge.select("key", "start", "h", F.col("x.bin").alias("edge"), ((F.col("h") - F.col("x.upto") + F.col("x.n")) / F.col("x.n")).alias("part"))
    told = now.select("key", "rows", "start", "center", "inverse").join(edge, ["key", "start"])

    def sums(x, r):
        b = bins(x, r)
        return [(r.key, r.start, *_fixed(x[b < r.edge]), *_fixed(x[b == r.edge]))]

    columns = [*_SUMS, *(f"e{c}" for c in _SUMS)]
    total = _over(blocks, told, tasks, sums, "key string, start int, " + ", ".join(f"{c} long" for c in columns))
    total = _held(total.groupBy("key", "start").agg(*(F.sum(c).alias(c) for c in columns)), tasks)
    total = total.join(told.select("key", "start", "rows", "h", "part"), ["key", "start"])

    def made(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                own = [getattr(r, c) + r.part * getattr(r, f"e{c}") for c in _SUMS]
                rows.append((r.key, r.rows, r.start, *_estimate(*_moments(own, r.h), factor)))
            yield pd.DataFrame(rows, columns=["key", "rows", "start", "center", "inverse", "log_det"])

    return total.mapInPandas(made, _ESTIMATE)


def estimates(vectors: DataFrame, share: float = 0.75, steps: int | None = None) -> DataFrame:
    """MCD location and inverse scatter for each key of (key, v, deal): key, center, inverse, log_det, rows.

    Each start takes steps until its determinant doesn't fall by a ten-thousandth, or `steps` of them where that is given.
    An empty table gives an empty table.
    """
    blocks = blocks_of(vectors)
    keys = blocks.select("key").distinct().limit(_FEW + 1).count()
    tasks = 1 + keys // _KEYS if keys <= _FEW else None
    # The variance of the three quarters nearest the centre is too small by this factor for normal rows.
    factor = _consistency(share, _DIM)
    now, ended = cut_lineage(_concentrated(blocks, cut_lineage(_starts(blocks, tasks)), tasks, share, factor)), []
    for step in range(1, 500):  # steps end by themselves; a long way would be an error
        if not now.limit(1).count():
            break
        if step == steps:
            ended.append(now)
            break
        new = cut_lineage(_concentrated(blocks, now, tasks, share, factor))
        both = _held(new, tasks).join(_held(now, tasks).select("key", "start", F.col("log_det").alias("before")), ["key", "start"])
        both = both.withColumn("falls", F.col("log_det") < F.col("before") - 1e-4)
        ended.append(both.where("not falls").drop("falls", "before"))
        now = cut_lineage(both.where("falls").drop("falls", "before").select(*new.columns))
    else:
        raise RuntimeError("determinants still fall after 500 steps")
    if not ended:
        return now.drop("start")
    every = _held(functools.reduce(DataFrame.unionByName, ended), tasks)
    best = every.groupBy("key").agg(F.min_by(F.struct("center", "inverse", "log_det", "rows"), F.struct("log_det", "start")).alias("x"))
    return best.select("key", "x.*")


def _chi_square_below(x: float, k: int) -> float:
    """P(chi-square with k (even) degrees <= x)."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def chi_square_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_below(mid, k) < p else (low, mid)
    return high


def _consistency(share: float, p: int) -> float:
    """share / P(chi2 with p + 2 degrees <= q), q the chi2 quantile of `share` with p degrees (p even)."""
    return share / _chi_square_below(chi_square_quantile(share, p), p + 2)


def judged(docs: DataFrame, tail: float = TAIL, least: int = 60) -> DataFrame:
    """Per document: doc_id, lang, source, text_hash, COUNTS, base_failed, distance (squared; null if base_failed), kept.

    Null languages and sources are groups of their own.  A null or empty text has no words and fails.  One row per
    input row, repeated rows included; the estimates are over all rows that pass the base rules.  tail: the share of
    normal rows that the distance rejects.  Columns other than doc_id, lang, source and text are not read.
    """
    counts = cut_lineage(text_counts(docs))
    rows = counts.withColumns({"base_failed": base_failed(), "v": _vector()})
    own, wide = F.concat(F.lit("both"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("lang"), F.to_json(F.struct("lang")))
    good = cut_lineage(rows.where("not base_failed").select(own.alias("own"), wide.alias("wide"), "v")).withColumn("deal", F.monotonically_increasing_id())
    # Only groups that some document needs are estimated: its own, or its language, or all.
    sizes = good.groupBy("own", "wide").agg(F.count("*").alias("n"))
    langs = sizes.groupBy("wide").agg(F.sum("n").alias("all"), F.count_if(F.col("n") < least).alias("small"))
    keys = sizes.join(langs, "wide").select(
        "own", F.array(
            F.when(F.col("n") >= least, F.col("own")), F.when((F.col("all") >= least) & (F.col("small") > 0), F.col("wide"))
        ).alias("keys"), (F.col("all") < least).alias("lonely"),
    )
    keys = cut_lineage(keys)
    lonely = bool(keys.where("lonely").limit(1).count())
    few = keys.limit(_FEW + 1).count() <= _FEW
    told = F.broadcast(keys) if few else keys
    every = F.array_append(F.col("keys"), F.lit("all")) if lonely else F.col("keys")
    vectors = good.join(told, "own").select(F.explode(F.array_compact(every)).alias("key"), "v", "deal")
    found = cut_lineage(estimates(vectors).select("key", "center", "inverse"))
    use = keys.select("own", F.coalesce(*(F.col("keys")[i] for i in range(2)), F.lit("all")).alias("key")).join(found, "key").drop("key")
    out = rows.withColumn("own", own).join(F.broadcast(use) if few else use, "own", "left")
    distance = F.when(~F.col("base_failed"), F.round(_distance(), 6))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_quantile(1 - tail, _DIM), F.lit(False))
    out = out.withColumn("distance", distance)
    return out.select("doc_id", "lang", "source", "text_hash", *COUNTS, "base_failed", "distance", kept.alias("kept"))


def quality_rules(docs: DataFrame, tail: float = TAIL, least: int = 60) -> DataFrame:
    """`judged` without lang, source and text_hash."""
    return judged(docs, tail, least).drop("lang", "source", "text_hash")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.  Rows equal in doc_id, lang, source and text
    have one verdict; a row is looked up by these (the text by a hash), so rows without id have verdicts of their own."""
    good = judged(docs).where("kept").select("doc_id", "lang", "source", "text_hash").distinct()
    row = docs.select("*", F.xxhash64("text").alias("text_hash")).alias("row")
    same = [F.col(f"row.{c}").eqNullSafe(F.col(f"good.{c}")) for c in ("doc_id", "lang", "source", "text_hash")]
    return row.join(good.alias("good"), same, "left_semi").select(*(F.col(f"row.{c}") for c in docs.columns))
