"""SentencePiece encoding and decoding as a relational lattice.

A text's segmentation is the path of pieces with the largest sum of scores (Viterbi), as SentencePiece's unigram mode
computes it from a piece table.  No piece reaches over two characters that stand side by side in no piece, such as a
word's end and the space after it, so the distinct parts between such places ("units", parts of words) are solved once
each: their substrings of at most the longest piece's length are exploded and equi-joined to the piece table, which
gives the lattice's edges; the edges are grouped by unit; and a higher-order aggregate folds them, in the order of
their ends, into the best score and last piece at each position.

Texts are shuffled once, compressed, into chunks.  A chunk sends the distinct units it has, one list for each range of
their hashes, to where the range's units are solved, and gets one list of ids for each list it sent.  Then it cuts its
texts again and puts the ids in the places of the units.  Chunks and ranges grow in number, not in size.

Rules, as in the model's own settings (identity normaliser): a space becomes U+2581, one more is put before a text
that isn't empty, and a character without a piece becomes its bytes' pieces at a cost 10 below the lowest score.  Of
paths with equal scores the one whose last piece starts earlier wins.  The installed model was trained as BPE; its
scores are merge ranks, and the best-scoring path is not always what merging in rank order gives.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import pack, pack_bytes, unpack, unpack_bytes
from .suffix_dedup import _range_of, _split
from .textarrays import _C, mix

SPACE = "▁"
_LONG = 256  # characters of a unit from which on positions are kept in blocks of this length


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(2)
def piece_table(path: str) -> tuple[list[tuple[str, float, int]], list[bytes], int]:
    """(piece, score, id) of the ordinary pieces, the bytes of every id, and the id of the byte piece of 0."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal, text, first = [], [], -1
    for i, p in enumerate(model.pieces):
        if p.type == p.BYTE:
            value = int(p.piece[3:5], 16)
            first = i - value
            text.append(bytes([value]))
        elif p.type in (p.NORMAL, p.USER_DEFINED):
            normal.append((p.piece, float(p.score), i))
            text.append(p.piece.replace(SPACE, " ").encode())
        else:
            text.append(b"")
    return normal, text, first


@functools.lru_cache(2)
def _alphabet(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The number of each code point that stands beside another in a piece (others: 0), and which numbers do so."""
    pairs = sorted({p[i : i + 2] for p, _, _ in piece_table(path)[0] for i in range(len(p) - 1)})
    if any("\n" in p for p in pairs):
        raise ValueError("a piece reaches over a line's end")
    letters = sorted({c for p in pairs for c in p})
    number = np.zeros(0x110000, np.int32)
    number[list(map(ord, letters))] = np.arange(1, len(letters) + 1)
    beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
    for a, b in pairs:
        beside[number[ord(a)], number[ord(b)]] = True
    return number, beside


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    p, q = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


class Units:
    """The units of some texts: the texts with their spaces replaced and one put before, and each unit's place in them.

    order has a distinct unit's number, by its 64-bit hash; at has the number of each unit of the texts; of those,
    those of text i are at bounds[i] to bounds[i + 1].
    """

    def __init__(self, texts: list[str], path: str, block: int = 1 << 18):
        number, beside = _alphabet(path)
        self.text = "".join(SPACE + t if t else "" for t in texts).replace(" ", SPACE)
        ends = np.cumsum([len(t) + bool(t) for t in texts], dtype=np.int64) if texts else np.empty(0, np.int64)
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        cut = np.ones(points.size + 1, bool)
        for s in range(1, points.size, block):
            own = number[points[s - 1 : s + block]]
            cut[s : s + own.size - 1] = ~beside[own[:-1], own[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        self.starts, self.stops = at[:-1], at[1:]
        self.bounds = np.append(0, np.searchsorted(self.starts, ends))
        hashes = np.empty(self.starts.size, np.uint64)
        i = 0
        while i < hashes.size:  # blocks of whole units
            s = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.starts, s + block)))
            e = self.stops[j - 1]
            power, inverse = _powers(1 << int(max(block, e - s)).bit_length())
            sums = np.append(np.uint64(0), np.cumsum(mix(points[s:e] * _C[1] + _C[2]) * power[: e - s], dtype=np.uint64))
            a, b = self.starts[i:j] - s, self.stops[i:j] - s
            hashes[i:j] = mix((sums[b] - sums[a]) * inverse[a] ^ (b - a).astype(np.uint64) * _C[3])
            i = j
        codes, distinct = pd.factorize(hashes)
        order = np.argsort(distinct)
        self.hashes = distinct[order]
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        self.at = place[codes]

    def distinct(self) -> list[str]:
        """The distinct units in order."""
        first = np.empty(self.hashes.size, np.int64)
        first[self.at[::-1]] = np.arange(self.at.size)[::-1]
        return [self.text[s:e] for s, e in zip(self.starts[first].tolist(), self.stops[first].tolist())]


def _gather(values: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The lists `pick` of lists that stand one after the other in values, joined."""
    n = sizes[pick]
    shift = (np.cumsum(sizes) - sizes)[pick] - np.cumsum(n) + n
    return values[np.repeat(shift, n) + np.arange(n.sum())]


def decode_ids(ids: np.ndarray, path: str | None = None) -> str:
    """The text of some ids, without the space put before it; stray bytes become U+FFFD."""
    table = piece_table(path or default_model())[1]
    data = b"".join(map(table.__getitem__, ids.tolist()))
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _fold_short() -> tuple[Column, Column]:
    """ids of the best path from a unit's sorted edges; the best at each position is kept in one array."""
    step = "struct(acc[x.s].score + x.score as score, x.s as s, x.id as id)"
    best = F.expr(f"""
        aggregate(edges, array(struct(0D as score, -1 as s, -1 as id)), (acc, x) -> case
            when size(acc) = x.e then concat(acc, array({step}))
            when acc[x.s].score + x.score > acc[x.e].score then concat(slice(acc, 1, x.e), array({step}))
            else acc end)""")
    back = "aggregate(best, struct(size(best) - 1 as at, cast(array() as array<int>) as ids), (st, x) -> if(st.at = 0, st, {0}))"
    step = "struct(best[st.at].s as at, concat(array(best[st.at].id), st.ids) as ids)"
    return best, F.expr(back.format(step) + ".ids")


def _fold_long(longest: int) -> tuple[Column, Column]:
    """The same in linear time and small steps: scores of the last positions only, and arrays that grow by blocks."""
    new = "struct(x.s as s, x.id as id)"
    score = f"acc.scores[size(acc.scores) - 1 - (if(x.e > acc.e, x.e - 1, x.e) - x.s)] + x.score"
    kept = f"if(size(acc.scores) > {longest}, slice(acc.scores, 2, {longest}), acc.scores)"
    full = f"size(acc.tail) = {_LONG}"
    best = F.expr(f"""
        aggregate(edges,
            named_struct('e', 0, 'scores', array(0D), 'last', named_struct('s', -1, 'id', -1),
                'blocks', cast(array() as array<array<struct<s:int,id:int>>>), 'tail', cast(array() as array<struct<s:int,id:int>>)),
            (acc, x) -> case
                when x.e > acc.e then named_struct('e', x.e, 'scores', concat({kept}, array({score})), 'last', {new},
                    'blocks', if({full}, concat(acc.blocks, array(acc.tail)), acc.blocks),
                    'tail', if({full}, array(acc.last), concat(acc.tail, array(acc.last))))
                when {score} > element_at(acc.scores, -1) then named_struct('e', acc.e,
                    'scores', concat(slice(acc.scores, 1, size(acc.scores) - 1), array({score})), 'last', {new},
                    'blocks', acc.blocks, 'tail', acc.tail)
                else acc end,
            acc -> flatten(concat(acc.blocks, array(acc.tail), array(array(acc.last)))))""")
    full = f"size(st.tail) = {_LONG}"
    ids = F.expr(f"""
        aggregate(long, named_struct('at', size(long) - 1, 'blocks', cast(array() as array<array<int>>), 'tail', cast(array() as array<int>)),
            (st, x) -> if(st.at = 0, st, named_struct('at', long[st.at].s,
                'blocks', if({full}, concat(st.blocks, array(st.tail)), st.blocks),
                'tail', if({full}, array(long[st.at].id), concat(st.tail, array(long[st.at].id))))),
            st -> reverse(flatten(concat(st.blocks, array(st.tail)))))""")
    return best, ids


def best_paths(units: DataFrame, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, unit -> ids of its best path; characters without a piece as minus their code point.

    The rows (keys, unit) are distinct.  A unit's edges are in one row, at most the longest piece's length for each
    character; units of over 256 characters are folded in steps whose cost doesn't grow with the unit.
    """
    spark: SparkSession = units.sparkSession
    normal, _, _ = piece_table(path)
    longest = max(len(p) for p, _, _ in normal)
    unknown = min(s for _, s, _ in normal) - 10
    # The vocabulary: tens of thousands of rows, whatever the corpus.
    pieces = F.broadcast(spark.createDataFrame(normal, "piece string, score double, id int"))
    n, by = F.length("unit"), [*keys, "unit"]
    edges = (
        units.sortWithinPartitions(*by)  # then the edges are in their groups' order as they are made
        .withColumn("s", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("e", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + longest))))
        .withColumn("piece", F.expr("substring(unit, s + 1, e - s)"))
        .join(pieces, "piece", "left")
        .where("id is not null or e = s + 1")
        .select(*by, F.struct("e", "s", F.coalesce("score", F.lit(unknown)).alias("score"), F.coalesce("id", -F.ascii("piece")).alias("id")).alias("x"))
    )
    lattice = edges.groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("edges"))
    (best, ids), (best_long, ids_long) = _fold_short(), _fold_long(longest)
    short = n <= _LONG
    lattice = lattice.select(*by, F.when(short, best).alias("best"), F.when(~short, best_long).alias("long"))
    return lattice.select(*by, F.when(short, ids).otherwise(ids_long).alias("ids"))


def encode(
    docs: DataFrame, path: str | None = None, chunk_bytes: int = 3 << 20, range_bytes: int = 3 << 20, bundle_bytes: int = 1 << 19
) -> DataFrame:
    """Per row of docs: doc_id, n_pieces, ids, round_trip (the decoded ids are the text).

    A null text counts as empty and has no ids.  Texts of any length are encoded whole; repeated rows as often as they
    occur.  Columns other than doc_id and text are not read.
    """
    path = path or default_model()
    spark: SparkSession = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, ranges = max(least, total // chunk_bytes), max(least, total // range_bytes)

    def bundle(batches):
        """Documents in bundles of about half a megabyte, compressed: the text crosses the network once."""
        held, size = [], 0

        def sent():
            data = [t.encode("utf-8", "surrogatepass") for _, _, t in held]
            ids, none = np.array([d for d, _, _ in held], np.int64), np.array([no for _, no, _ in held], np.uint8)
            sizes = np.array([len(x) for x in data], np.int64)
            row = (int(ids[0]), pack(ids), pack(none), pack(sizes), pack_bytes(b"".join(data), 6))
            return pd.DataFrame([row], columns=["first", "ids", "none", "sizes", "data"])

        for pdf in batches:
            for row in zip(pdf["id"].tolist(), pdf["no_id"].tolist(), pdf["text"].tolist()):
                held.append(row)
                size += len(row[2])
                if size > bundle_bytes or len(held) >= 4096:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    bundles = docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text")
    ).mapInPandas(bundle, "first long, ids binary, none binary, sizes binary, data binary")
    parts = bundles.withColumn("chunk", F.pmod(F.xxhash64("first", "sizes"), F.lit(chunks)).cast("int")).groupBy("chunk")

    def texts_of(pdf: pd.DataFrame) -> tuple[list[int], list[bool], list[str]]:
        ids, none, texts = [], [], []
        for i, no, n, data in zip(pdf["ids"], pdf["none"], pdf["sizes"], pdf["data"]):
            data, ends = unpack_bytes(data), np.cumsum(unpack(n, np.int64)).tolist()
            ids += unpack(i, np.int64).tolist()
            none += unpack(no, np.uint8).astype(bool).tolist()
            texts += [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip([0, *ends], ends)]
        return ids, none, texts

    def lists(pdf: pd.DataFrame) -> pd.DataFrame:
        """The chunk's distinct units, one list for each range; a line's end, always a unit alone, is the empty one."""
        pdf = pdf.sort_values(["first", "data"])
        own = Units(texts_of(pdf)[2], path)
        found, chunk = own.distinct(), int(pdf["chunk"].iloc[0])
        rows = [(r, chunk, "\n".join(["" if (u := found[k]) == "\n" else u for k in i.tolist()])) for r, i in _split(_range_of(own.hashes, ranges))]
        return pd.DataFrame(rows, columns=["range", "chunk", "units"])

    sent = parts.applyInPandas(lists, "range int, chunk int, units string")
    sent = sent.repartition(ranges, "range")  # a fixed number: what comes of a row is a hundred times its size
    # All columns of what was sent are used, so that both uses of it share one exchange.
    each = sent.select(F.col("range").alias("of"), "chunk", F.explode(F.split("units", "\n", -1)).alias("unit"))
    distinct = each.groupBy("of", "unit").agg(F.max("chunk").alias("chunk")).where("chunk >= 0")
    line = F.when(F.col("unit") == "", "\n").otherwise(F.col("unit"))
    solved = best_paths(distinct.select("of", line.alias("unit")), path, ("of",))

    def answer(pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """For each list of units their ids, one after the other, and how many each has."""
        first = piece_table(path)[2]
        place = {"" if u == "\n" else u: k for k, u in enumerate(known["unit"].tolist())}
        sizes = np.fromiter(map(len, known["ids"]), np.int64, len(known))
        ids = np.concatenate([np.empty(0, np.int32), *known["ids"]]).astype(np.int32)
        less = np.flatnonzero(ids < 0)
        if less.size:  # characters without a piece: their bytes' pieces
            data = [chr(-i).encode("utf-8", "surrogatepass") for i in ids[less].tolist()]
            n = np.ones(ids.size, np.int64)
            n[less] = list(map(len, data))
            unit = np.repeat(np.arange(sizes.size), sizes)
            sizes = np.bincount(unit, n, sizes.size).astype(np.int64)
            ids = np.repeat(ids, n)
            ids[ids < 0] = first + np.frombuffer(b"".join(data), np.uint8)
        rows = []
        for r, chunk, units in zip(pdf["range"], pdf["chunk"], pdf["units"]):
            pick = np.fromiter(map(place.__getitem__, units.split("\n")), np.int64)
            rows.append((chunk, r, pack(sizes[pick].astype(np.int32)), pack(_gather(ids, sizes, pick).astype(np.int32))))
        return pd.DataFrame(rows, columns=["chunk", "range", "sizes", "ids"])

    answers = sent.groupBy("range").cogroup(solved.groupBy("of")).applyInPandas(answer, "chunk int, range int, sizes binary, ids binary")

    def assemble(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "no_id", "n_pieces", "ids", "round_trip"]
        if not len(pdf):
            return pd.DataFrame([], columns=names)
        pdf, told = pdf.sort_values(["first", "data"]), told.sort_values("range")
        doc_ids, none, texts = texts_of(pdf)
        own = Units(texts, path)
        sizes = np.concatenate([np.empty(0, np.int32), *(unpack(x, np.int32) for x in told["sizes"])]).astype(np.int64)
        ids = np.concatenate([np.empty(0, np.int32), *(unpack(x, np.int32) for x in told["ids"])])
        table = piece_table(path)[1]
        length = np.array([len(x) for x in table], np.int64)
        data = np.frombuffer(b"".join(table), np.uint8)
        rows = []
        for i, (d, no, t) in enumerate(zip(doc_ids, none, texts)):
            if i % 1024 == 0:  # a thousand documents at once
                j = min(len(texts), i + 1024)
                pick = own.at[own.bounds[i] : own.bounds[j]]
                flat, n = _gather(ids, sizes, pick), np.append(0, np.cumsum(sizes[pick]))
                at = n[own.bounds[i : j + 1] - own.bounds[i]]
                back, n = _gather(data, length, flat).tobytes(), np.append(0, np.cumsum(length[flat]))
                to = n[at]
            k = i % 1024
            mine, back_ = flat[at[k] : at[k + 1]], back[to[k] : to[k + 1]]
            rows.append((d, no, mine.size, mine, back_[1:] == t.encode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=names)

    out = parts.cogroup(answers.groupBy("chunk")).applyInPandas(
        assemble, "id long, no_id boolean, n_pieces long, ids array<int>, round_trip boolean"
    )
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_pieces", "ids", "round_trip")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of `ids` (null ids: null); other columns are not read."""
    path = path or default_model()

    def run(batches):
        for pdf in batches:
            text = [None if i is None else decode_ids(np.asarray(i, np.int64), path) for i in pdf["ids"]]
            yield pd.DataFrame({"id": pdf["id"], "no_id": pdf["no_id"], "text": text})

    rows = encoded.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "ids")
    out = rows.mapInPandas(run, "id long, no_id boolean, text string")
    return out.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text")
