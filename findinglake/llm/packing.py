"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Each document is tokenised where it is read, in one pass; only lengths and checksums of its pieces move on.  Pieces
of full length are a sequence each.  The rest are dealt into packing groups of about `group_rows` pieces by a hash;
each group is packed by best-fit decreasing, with a segment tree over remaining capacities that finds the tightest
open sequence in logarithmic time.  At most one sequence of a group stays half empty or more; the pieces of these are
dealt and packed again, in as many groups fewer, until one group is left.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage
from .workers import release, remembered

# Words of the tokenizer's own pattern, for texts of Latin-1 characters (letters and digits are spelled out).
_L1_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_L1_DIGIT = "0-9²³¹¼½¾"
_L1_SPACE = " \t\n\x0b\x0c\r\x85\xa0"
_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_L1_LETTER}]+|[{_L1_DIGIT}]|[^{_L1_SPACE}{_L1_LETTER}{_L1_DIGIT}]+"
)
_OTHER = re.compile("[^\x00-\xff]|<\\|(?:start|end)oftext\\|>")
# The same words of lower-cased ASCII texts; the branches begin with different characters, so the commonest stands first.
_ASCII_WORDS = re.compile("[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^ \t\n\x0b\x0c\ra-z0-9]+")


class Encoder:
    """Ids of the tokenizer as packed little-endian 32-bit integers.

    Every word is encoded by the tokenizer itself, and its ids are remembered: at most `limit` words, in two halves.  When
    the younger half is full it becomes the older one, which is forgotten but for the words met again since, so frequent
    words stay.  Texts outside Latin-1 and texts with special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Words that aren't known yet: those of the older half, the others in one run, parted by spaces as in a text."""
        kept = {w: self.older[w] for w in words if w in self.older}
        new = [w for w in words if w not in kept]
        if len(self.known) + len(words) > self.limit // 2:
            self.older, self.known = self.known, {}
        self.known.update(kept)
        if not new:
            return
        e = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids, word = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids, np.int64)
        ends = (4 * np.append(np.flatnonzero(word[1:] != word[:-1]) + 1, word.size)).tolist()
        if len(ends) == len(new):
            self.known.update({w: ids[a:b] for w, a, b in zip(new, [0, *ends], ends)})
        else:  # a tokenizer that cuts a word further, or drops one
            self.known.update({w: self.whole(w) for w in new})

    def __call__(self, text: str) -> bytes:
        ascii_ = text.isascii()
        if (not ascii_ or "<|" in text) and _OTHER.search(text):
            return self.whole(text)
        found = (_ASCII_WORDS if ascii_ else _WORDS).findall(text.lower())
        parts = list(map(self.known.get, found))
        if None in parts:
            self.learn(list(dict.fromkeys(w for w, p in zip(found, parts) if p is None)))
            parts = [p if p is not None else self.known[w] for w, p in zip(found, parts)]
        return b"".join(parts)


@remembered
@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_PIECE = "id long, no_id boolean, piece int, start long"


def pieces(docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Per piece of each document: id and no_id (without id: 0, true), piece, start, length, ids_crc32.  No shuffle."""
    path = path or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        release(keep=encoder)
        encode = encoder(path)
        for pdf in batches:
            rows = []
            for d, no, t in zip(pdf["id"].tolist(), pdf["no_id"].tolist(), pdf["text"].tolist()):
                ids = encode(t or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((d, no, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["id", "no_id", "piece", "start", "length", "ids_crc32"])
        release(keep=encoder)

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("no_id"), "text")
    return rows.mapInPandas(run, f"{_PIECE}, length long, ids_crc32 long")


class _Capacities:
    """A segment tree over remaining capacities 0..size; each leaf counts the open sequences of that capacity."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = capacity + self.width
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The open sequence with the smallest capacity of at least `least`, removed: (capacity, sequence)."""
        i, count = least + self.width, self.count
        while not count[i]:
            while i & 1:  # a right child: go on to the parent
                i >>= 1
            if not i:
                return None
            i += 1  # the sibling to the right
        while i < self.width:
            i = 2 * i if count[2 * i] else 2 * i + 1
        capacity, j = i - self.width, i
        while j:
            count[j] -= 1
            j >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length, taken in the given (falling) order."""
    tree, sequences = _Capacities(size), 0
    sequence, offset = np.empty(lengths.size, np.int64), np.empty(lengths.size, np.int64)
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            found = size, sequences
            sequences += 1
        capacity, s = found
        sequence[i], offset[i] = s, size - capacity
        if capacity > n:
            tree.add(capacity - n, s)
    return sequence, offset


def pack(
    docs: DataFrame, path: str | None = None, size: int = 4096, end_id: int = 1, group_rows: int = 20_000
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id; only documents over `size` are cut.  A null text is empty and so one token.
    Repeated rows are packed as often as they occur; a null id stays null.  Sequence ids are made of the
    round, group and number.  Columns other than doc_id and text are not read.
    """
    found = cut_lineage(pieces(docs, path, size, end_id))
    part = F.col("length") < size
    order = ["no_id", "id", "piece", "ids_crc32"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", *order], ascending=[False, *[True] * len(order)])
        s, o = best_fit(pdf["length"].to_numpy(), size)
        fill = np.bincount(s, pdf["length"], s.max() + 1)
        return pdf.assign(sequence_id=s + int(pdf["pack"].iloc[0]), offset=o, loose=2 * fill[s] <= size).drop(columns="pack")

    schema = f"{_PIECE}, length long, ids_crc32 long, sequence_id long, offset long"
    rest, done, level = found.where(part), [], 0
    groups = max(1, -(-rest.count() // group_rows))
    while True:
        pack_ = F.pmod(F.xxhash64(*order, F.lit(level)), F.lit(groups)) * (1 << 32) + F.lit(level << 58)
        dealt = rest.withColumn("pack", pack_.cast("long")).groupBy("pack").applyInPandas(one, f"{schema}, loose boolean")
        if groups == 1:
            done.append(dealt.drop("loose"))
            break
        dealt = cut_lineage(dealt)
        done.append(dealt.where("not loose").drop("loose"))
        rest = dealt.where("loose").drop("sequence_id", "offset", "loose")
        groups, level = min(groups - 1, max(1, -(-rest.count() // group_rows))), level + 1
    whole = found.where(~part).withColumns(
        {"sequence_id": F.monotonically_increasing_id() + F.lit(1 << 62), "offset": F.lit(0).cast("long")}
    )
    out = functools.reduce(DataFrame.unionByName, [*done, whole])
    doc_id = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    return out.select(doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
