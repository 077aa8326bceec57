"""Exact Jaccard similarity join of word n-gram sets by PartEnum signatures.

Sizes fall into bands [l, u] with u = l / threshold.  A similar pair whose smaller set is in a band has a larger set in
this band or the next, and differs in at most k = (1 - t) / (1 + t) * (u + u / t) elements.  For each of the two bands
that concern it a set is signed in two levels.  The domain is dealt into n1 parts, each of them into n2 cells, and for
every part each subset of n2 - k2 of its cells gives a signature: the hash of the set's elements in those cells.  With
n1 = k // (k2 + 1) + 1 + e parts, k differences leave e + 1 parts with at most k2 differences, and these lie in at most
k2 cells, so a similar pair shares a subset in each of those parts.

A subset without elements says nothing and would be shared by many sets.  A part is weak for a set whose elements lie
in k2 of its cells or fewer.  If one of a similar pair has at most e weak parts, one of the e + 1 shared subsets has
elements, and empty ones aren't needed.  A set with more weak parts is signed once more by another dealing of the
domain (its partner, if it has too many as well, is too), `_DEALS` times at most; what is then left, a few sets in many
millions, gives its empty subsets too.

Where sets meet, only pairs with the smallest document of a signature are told (a star, not all pairs of a group), and
of documents with equal sets only the first takes part.  Members of a star are compared with its centre first, in
blocks.  Then each document takes the smallest id within a few links as its label; equal labels mean one component.
Members whose label isn't their centre's are compared, in pairs of blocks, with all members of other labels.  So a link
inside a component may not be looked at, but none between components is lost.  A comparison begins with sizes and with parities of hashed bits, some 30 times smaller than the sets, which both bound
the overlap exactly; sets move only for documents that pass.

Signatures travel as sorted arrays per (chunk of documents, range of signatures), with as many bits as make chance
meetings rare in an input of its size.  Elements are 64-bit hashes of words; two different n-grams that share one count
as equal.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import pack, pack_sorted, unpack, unpack_sorted
from .components import components, tasks_for
from .suffix_dedup import _range_of, _split
from .tables import cut_lineage
from .textarrays import _C, blocks, mix, shingles, span_hashes, words
from .workers import lean, lean_pair

_CENTRE, _COPY = -1, -2  # no node: mark a centre, and a document whose set an earlier one has
_CELLS, _SPARE = 3, 1  # n2 and k2
_DEALS = 6
_NODES = 2_000_000  # so many node numbers are broadcast at most (some 100 MB); more are joined by a shuffle


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's `size`-word windows; a shorter text is one window; no words: empty.

    A-Z are lower-cased; words are runs of anything but space and tab to carriage return.
    """
    out = []
    for i, j in blocks(texts):
        buf, s, e, owner = words([t.lower() for t in texts[i:j]])
        h = span_hashes(buf, s, e)
        value, who = shingles(h, owner, size)
        ends = np.searchsorted(who, np.arange(j - i + 1))
        count = np.searchsorted(owner, np.arange(j - i + 1))
        for k in range(j - i):
            x = value[ends[k] : ends[k + 1]]
            if not x.size and count[k + 1] > count[k]:
                x = np.zeros(1, np.uint64)
                for n, y in enumerate(h[count[k] : count[k + 1]]):
                    x = mix(x * _C[n % 10] + y + np.uint64(n + 1))
            out.append(np.unique(x))
    return out


@functools.lru_cache(4)
def bands(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands for a threshold in percent: 1, ..., each band's upper end its lower / threshold."""
    low = [1]
    while low[-1] < most:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def plan(band: int, percent: int) -> tuple[int, int, int, int]:
    """(parts n1, cells n2, spare k2, e) for pairs whose smaller set is in the band."""
    upper = int(bands(percent)[band + 1]) - 1
    k = (100 - percent) * (upper + upper * 100 // percent) // (100 + percent)
    if k == 0:
        return 1, 1, 0, 0
    least = k // (_SPARE + 1) + 1
    e = (least + 5) // 6
    return least + e, _CELLS, _SPARE, e


def _signed(sets: list[np.ndarray], salt: np.uint64, n1: int, n2: int, k2: int, e: int, last: bool):
    """Signatures of some sets under one dealing: (signature, index of the set, sets with more than e weak parts)."""
    sizes = np.array([x.size for x in sets])
    h = mix(np.concatenate(sets) ^ salt)
    cells = n1 * n2
    at = np.repeat(np.arange(len(sets)) * cells, sizes) + ((h >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    value = np.zeros(len(sets) * cells, np.uint64)
    np.add.at(value, at, mix(h + _C[7]))
    value = value.reshape(len(sets), n1, n2)
    used = (np.bincount(at, minlength=value.size) > 0).reshape(value.shape)
    many = (used.sum(2) <= k2).sum(1) > e
    sigs, owners = [], []
    for nth, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
        v, live = value[:, :, subset[0]].copy(), used[:, :, subset[0]].copy()
        for c in subset[1:]:
            v += value[:, :, c]
            live |= used[:, :, c]
        if last:
            live |= many[:, None]
        own, part = np.nonzero(live)
        sigs.append(mix(v[own, part] + mix((part * 64 + nth).astype(np.uint64) ^ salt)))
        owners.append(own)
    return np.concatenate(sigs), np.concatenate(owners), np.flatnonzero(many)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of some sets: (signature of 64 bits, index of the set)."""
    low = bands(percent)
    sizes = np.array([x.size for x in sets], np.int64)
    band = np.searchsorted(low, sizes, "right") - 1
    sigs, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for down in (0, 1):
        for b in np.unique(band[(sizes > 0) & (band >= down)]):
            own = np.flatnonzero((band == b) & (sizes > 0))
            how = plan(int(b) - down, percent)
            for part in np.array_split(own, max(1, int(sizes[own].sum()) >> 18)):
                for deal in range(_DEALS):
                    salt = mix(np.array([(int(b) - down + 1) * _DEALS + deal], np.uint64))[0]
                    value, who, left = _signed([sets[i] for i in part], salt, *how, deal == _DEALS - 1)
                    sigs.append(value)
                    owners.append(part[who])
                    part = part[left]
                    if not part.size:
                        break
    return np.concatenate(sigs), np.concatenate(owners)


class _Rows:
    """The documents of one chunk in a fixed order, which numbers them: node = chunk * 2^32 + place."""

    def __init__(self, pdf: pd.DataFrame, size: int):
        pdf = pdf.assign(text=pdf["text"].fillna("")).sort_values(["no_id", "id", "text"], ignore_index=True)
        self.ids, self.none = pdf["id"].to_numpy(), pdf["no_id"].to_numpy()
        self.nodes = (int(pdf["chunk"].iloc[0]) << 32) + np.arange(len(pdf), dtype=np.int64)
        self.sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in pdf["text"]], size)
        self.keys = np.array([_key(x) for x in self.sets], np.uint64).reshape(-1, 2)
        fit = np.array([x.size > 0 for x in self.sets]) & ~self.none
        known: set[tuple[int, int]] = set()
        for i, k in enumerate(map(tuple, self.keys.tolist())):  # of equal sets the first speaks
            fit[i] &= k not in known
            if fit[i]:
                known.add(k)
        self.speakers = np.flatnonzero(fit)


def _key(x: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others."""
    return tuple(int(np.add.reduce(mix(x ^ c)) + np.uint64(x.size)) & (2**64 - 1) for c in (_C[8], _C[9]))


def _joined(parts, dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *parts])


def _stars(pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Of one range: (first document, other document) of each signature, without repeats; and those of each set's key."""
    pdf = pdf.sort_values("chunk")
    rows = []
    for copies in (False, True):
        own = pdf[pdf["copies"] == copies]
        if not len(own):
            continue
        # A chunk's nodes are greater than those of chunks before it, and in order where signatures are equal.
        sig = _joined(map(unpack_sorted, own["sigs"]), np.uint64)
        node = _joined((unpack(x, np.int64) for x in own["nodes"]), np.int64)
        if copies:
            more = _joined((unpack(x, np.uint64) for x in own["more"]), np.uint64)
            order = np.lexsort((node, more, sig))
            new = np.append(True, (sig[order][1:] != sig[order][:-1]) | (more[order][1:] != more[order][:-1]))
        else:
            order = np.argsort(sig, kind="stable")
            new = np.append(True, sig[order][1:] != sig[order][:-1])
        node = node[order]
        first = node[np.flatnonzero(new)][np.cumsum(new) - 1]
        pair = np.stack([first, node])[:, ~new]
        if copies:
            pair[0] = _COPY
        else:
            pair = np.unique(pair, axis=1) if pair.size else pair
        where = mix(pair[0].astype(np.uint64) ^ mix(pair[1].astype(np.uint64))) % np.uint64(buckets)
        rows += [(b, pack(pair[0][i]), pack(pair[1][i])) for b, i in _split(where.astype(np.int64))]
    return pd.DataFrame(rows, columns=["bucket", "centre", "other"])


def _distinct_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = (np.concatenate([unpack(x, np.int64) for x in pdf[c]]) for c in ("centre", "other"))
    a, b = np.unique(np.stack([a, b]), axis=1)
    return pd.DataFrame({"centre": a, "other": b})


def _sketch(x: np.ndarray) -> bytes:
    """Which of 2 bits for each element or more (a power of 2, 256 at least) an odd number of elements is hashed to."""
    bits = 256 << max(0, int(2 * x.size - 1).bit_length() - 8)
    odd = np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows, folded to the smallest one's size."""
    least = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, least // 8), axis=0) for x in sketches])


def _may_differ(a, b, percent: int):
    """|A xor B| = a + b - 2i, and 100 i >= p (a + b - i) is |A xor B| <= (a + b)(100 - p) / (100 + p)."""
    return (a + b) * (100 - percent) // (100 + percent)


def similar_to(x: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Indexes of the sets with 100 * intersection >= percent * union with x; none of them is empty."""
    if not sets:
        return np.empty(0, np.int64)
    n = np.array([y.size for y in sets])
    joined = np.concatenate(sets)
    at = np.minimum(np.searchsorted(x, joined), x.size - 1)
    both = np.add.reduceat((x[at] == joined).astype(np.int64), np.cumsum(n) - n)
    return np.flatnonzero(100 * both >= percent * (x.size + n - both))


def _tasks(pdf: pd.DataFrame):
    """Rows of the tasks (centre, i, j) that share a group, heads first and in the order of nodes: (rows, first, end,
    end of heads, and for head k the others it is compared with as places from the first: the members, or where i is
    -1 the members and the heads after it)."""
    pdf = pdf.sort_values(["centre", "i", "j", "head", "node"], ascending=[True, True, True, False, True], ignore_index=True)
    key = pdf[["centre", "i", "j"]].to_numpy()
    cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
    for s, e in zip(cut, np.append(cut[1:], len(pdf))):
        m, whole = int(pdf["head"].to_numpy()[s:e].sum()), key[s, 1] < 0
        yield pdf, int(s), int(e), m, (lambda k, m=m, n=int(e - s), whole=whole: np.arange(k + 1 if whole else m, n))


def _sifted(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Heads and members that have a partner in their task, of another component, that sizes and sketches don't rule out."""
    live, out = np.zeros(len(pdf), bool), pdf
    for out, s, e, m, others in _tasks(pdf):
        n, node, group = (out[c].to_numpy()[s:e] for c in ("n", "node", "component"))
        bits = _folded(out["sketch"].iloc[s:e].tolist())
        for k in range(m):
            right = others(k)
            r = right[(node[right] != node[k]) & (group[right] != group[k])]
            limit = _may_differ(n[k], n[r], percent)
            r = r[(np.abs(n[k] - n[r]) <= limit) & (np.bitwise_count(bits[k] ^ bits[r]).sum(1) <= limit)]
            live[s + r] = True
            live[s + k] |= r.size > 0
    return out.loc[live, ["task", "centre", "i", "j", "node", "head", "component"]]


def _linked(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of heads and members: links (a, b) of documents that join components that aren't joined in this group yet."""
    label: dict[int, int] = {}

    def root(k: int) -> int:
        label.setdefault(k, k)
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    rows = []
    for out, s, e, m, others in _tasks(pdf):
        node, group, ids = (out[c].to_numpy()[s:e] for c in ("node", "component", "id"))
        sets = [unpack_sorted(x) for x in out["elements"].iloc[s:e]]
        n = np.array([x.size for x in sets])
        for k in range(m):
            right = others(k)
            r = right[(node[right] != node[k]) & (np.abs(n[right] - n[k]) <= _may_differ(n[k], n[right], percent))]
            r = r[[root(int(x)) != root(int(group[k])) for x in group[r]]] if r.size else r
            for j in r[similar_to(sets[k], [sets[j] for j in r], percent)]:
                a, b = root(int(group[k])), root(int(group[j]))
                if a != b:
                    label[max(a, b)] = min(a, b)
                    rows.append((ids[j], ids[k]))
    return pd.DataFrame(rows, columns=["a", "b"], dtype="int64")


def _labels(links: DataFrame, hops: int = 3) -> DataFrame:
    """doc and label: the smallest document within some links of it; only documents with links have a row."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.coalesce(tasks_for(links.count()))
    out = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("label"))
    for _ in range(hops - 1):
        next_ = both.join(out, F.col("b") == F.col("doc")).groupBy("a").agg(F.min("label").alias("label"))
        out = next_.select(F.col("a").alias("doc"), F.least("a", "label").alias("label"))
    return out


def jaccard_groups(
    docs: DataFrame, size: int = 5, percent: int = 80, chunk_bytes: int = 6 << 20, range_bytes: int = 12 << 20, block: int = 2 << 20
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Documents link when 100 * intersection >= percent * union of their sets.  Empty sets link with nothing.
    component_id is the smallest doc_id reachable by links, the document's own included.  Rows that share a doc_id have
    one component, which has all links of each of them; each counts its own shingles.  A null doc_id links with nothing
    and has a null component.  Columns other than doc_id and text are not read.

    chunk_bytes, range_bytes: text for each chunk of documents and each range of signatures.  block: elements of a
    star's members that one task compares with as many others; a star with more has several blocks.
    """
    spark: SparkSession = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, ranges = max(least, total // chunk_bytes), max(least, total // range_bytes)
    # There are fewer signatures than bytes; 12 more bits make a chance meeting rare for a document's few hundred.
    drop = np.uint64(max(0, 64 - max(32, int(total).bit_length() + 12)))
    parts = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    ).groupBy("chunk")

    def sign(pdf: pd.DataFrame) -> pd.DataFrame:
        own, chunk = _Rows(pdf, size), int(pdf["chunk"].iloc[0])
        sig, owner = signatures([own.sets[i] for i in own.speakers], percent)
        sig >>= drop
        order = np.lexsort((owner, sig))
        sig, node = sig[order], own.nodes[own.speakers[owner[order]]]
        rows = [(r, chunk, False, pack_sorted(sig[i]), pack(node[i]), b"") for r, i in _split(_range_of(sig << drop, ranges))]
        key = own.keys[own.speakers]
        key, node = key[np.argsort(key[:, 0])], own.nodes[own.speakers[np.argsort(key[:, 0])]]
        for r, i in _split(_range_of(key[:, 0], ranges)):
            rows.append((r, chunk, True, pack_sorted(key[i, 0]), pack(node[i]), pack(key[i, 1])))
        return pd.DataFrame(rows, columns=["range", "chunk", "copies", "sigs", "nodes", "more"])

    stars = (
        parts.applyInPandas(lean(sign), "range int, chunk int, copies boolean, sigs binary, nodes binary, more binary")
        .groupBy("range")
        .applyInPandas(lean(lambda pdf: _stars(pdf, ranges)), "bucket int, centre binary, other binary")
        .groupBy("bucket")
        .applyInPandas(lean(_distinct_pairs), "centre long, other long")
    )
    # Each document with a candidate learns its centres; a centre learns that it is one.  Pairs come back with
    # the documents' sets, so all this is one job and the texts are shuffled once.
    heads = stars.where(F.col("centre") >= 0).select(F.col("centre").alias("other"), F.lit(_CENTRE).cast("long").alias("centre")).distinct()
    wanted = stars.unionByName(heads).withColumn("chunk", F.shiftright("other", 32).cast("int"))

    names = ["node", "id", "no_id", "n", "key1", "key2", "sketch", "elements", "centres"]

    def tell(pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame([], columns=names)
        own = _Rows(pdf, size)
        centres: list[list[int]] = [[] for _ in own.sets]
        for i, c in zip((want["other"] & 0xFFFFFFFF).tolist(), want["centre"].tolist()):
            centres[i].append(c)
        key = own.keys.view(np.int64)
        rows = []
        for node, i, no, x, (k1, k2), c in zip(own.nodes.tolist(), own.ids.tolist(), own.none, own.sets, key.tolist(), centres):
            ships = bool(c) and _COPY not in c  # the first with the set is in all its stars
            more = (_sketch(x), pack_sorted(x), sorted(y for y in c if y >= 0)) if ships else (None, None, [])
            rows.append((node, i, no, x.size, k1, k2, *more))
        return pd.DataFrame(rows, columns=names)

    told = cut_lineage(
        parts.cogroup(wanted.groupBy("chunk")).applyInPandas(
            lean_pair(tell), "node long, id long, no_id boolean, n long, key1 long, key2 long, sketch binary, elements binary, centres array<long>"
        )
    )
    same = told.where("n > 0 and not no_id").groupBy("n", "key1", "key2").agg(F.min("id").alias("b"), F.max("id").alias("m"))
    copies = told.where("not no_id").join(same.where("m > b"), ["n", "key1", "key2"]).select(F.col("id").alias("a"), "b")

    # A document's component begins as its own id.
    sketches = told.where("sketch is not null").select("node", F.col("id").alias("component"), "n", "sketch")
    sets = told.where("elements is not null").select("node", "id", "elements")
    pairs = cut_lineage(told.select(F.explode("centres").alias("centre"), "node", "n"))
    spread = max(4 * least, pairs.count() // 5_000)

    def compared(tasks: DataFrame, groups: DataFrame) -> DataFrame:
        """Links (a, b) of tasks (centre, i, j, node, head), each of heads against members of other components."""
        task = F.pmod(F.xxhash64("centre", "i", "j"), F.lit(spread)).cast("int").alias("task")
        live = tasks.select("*", task).join(groups, "node").groupBy("task").applyInPandas(
            lean(lambda pdf: _sifted(pdf, percent)), "task int, centre long, i int, j int, node long, head boolean, component long"
        )
        live = cut_lineage(live)
        some = live.select("node").distinct()
        some = F.broadcast(some) if some.limit(_NODES + 1).count() <= _NODES else some
        return cut_lineage(
            live.join(sets.join(some, "node", "left_semi"), "node").groupBy("task")
            .applyInPandas(lean(lambda pdf: _linked(pdf, percent)), "a long, b long")
        )

    blocks_of = F.ceil(F.sum("n") / block).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    block_of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    row = lambda i, j, head: ["centre", i.alias("i"), j.alias("j"), "node", F.lit(head).alias("head")]
    zero = F.lit(0)
    sizes = pairs.groupBy("centre").agg(blocks_of.alias("nb"))

    members = pairs.drop("n").join(sizes, "centre").withColumn("at", block_of("nb"))
    heads = sizes.select("centre", F.col("centre").alias("node"), each("nb").alias("at"))
    near = compared(members.select(*row(F.col("at"), zero, False)).unionByName(heads.select(*row(F.col("at"), zero, True))), sketches)
    links = cut_lineage(copies.unionByName(near))
    own = _labels(links)
    labels = sketches.join(own, sketches["component"] == own["doc"], "left").select(
        "node", F.coalesce("label", "component").alias("component"), "n", "sketch"
    )
    labels = cut_lineage(labels)
    of = labels.select("node", "component")
    both = pairs.join(of, "node").join(of.select(F.col("node").alias("centre"), F.col("component").alias("other")), "centre")
    both = both.select("centre", "node", "n", (F.col("component") != F.col("other")).alias("far"))
    both = cut_lineage(both)
    # A star of one block is one task, whose heads are the far members.  Task (i, j) of others: block i of the far
    # members, block j of all members.
    far_blocks = F.ceil(F.sum(F.when(F.col("far"), F.col("n"))) / block).cast("int")
    counts = both.groupBy("centre").agg(far_blocks.alias("nf"), blocks_of.alias("nb")).where("nf is not null")
    both = both.join(counts, "centre")
    one, many = both.where("nb = 1"), both.where("nb > 1")
    tasks = one.select("centre", F.lit(-1).alias("i"), F.lit(-1).alias("j"), "node", F.col("far").alias("head"))
    tasks = tasks.unionByName(many.where("far").select(*row(block_of("nf"), each("nb"), True)))
    tasks = tasks.unionByName(many.withColumn("at", block_of("nb")).select(*row(each("nf"), F.col("at"), False)))
    found = components(links.unionByName(compared(tasks, labels))).withColumnRenamed("node", "node_")
    return told.withColumn("doc_id", F.when(~F.col("no_id"), F.col("id"))).join(found, F.col("doc_id") == F.col("node_"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, and of equal ones (id and text) one; all columns.

    Rows that share an id but not a text are documents of their own: both stay, or both go.  Rows without id all stay.
    """
    first = jaccard_groups(docs).where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    first = cut_lineage(first)
    kept = docs.join(first.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    if first.where("rows > 1").limit(1).count():
        again = first.where("rows > 1").select("doc_id")
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("x"))
        one = one.select("doc_id", "text", "x.*").select(*docs.columns)
        kept = kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(one)
    return kept.unionByName(docs.where("doc_id is null"))
