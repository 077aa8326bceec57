"""Numpy views of text: word spans, word hashes, shingle hashes and byte windows of whole blocks of documents."""

from __future__ import annotations

import functools

import numpy as np

_C = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165],
    np.uint64,
)
_S1, _S2, _S3 = np.uint64(33), np.uint64(29), np.uint64(32)
_TABLE = np.random.default_rng(20240131).integers(1, 2**64, 256, np.uint64, endpoint=False)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> _S1
    h *= _C[0]
    h ^= h >> _S2
    h *= _C[1]
    h ^= h >> _S3
    return h


def loads(buf: np.ndarray, big: bool = False) -> np.ndarray:
    """The eight bytes at every position as one integer (a view; no copy)."""
    return np.ndarray((max(0, buf.size - 7),), ">u8" if big else "<u8", buf.data, 0, (1,))


def window_hash(buf: np.ndarray, size: int, salt: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """The 64-bit hash of the `size` (8 or more) bytes at every position, or at the positions `at`."""
    u, n = loads(buf), buf.size - size + 1
    h = np.zeros(max(0, n) if at is None else at.size, np.uint64)
    for i, o in enumerate([*range(0, size - 8, 8), size - 8]):
        part = u[o : o + n] if at is None else u[at + o]
        h ^= part * _C[(2 * i + salt) % 10]
        h ^= h >> _S2
        h *= _C[(2 * i + 1 + salt) % 10]
    return mix(h)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    p, q = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 64-bit hash of each span of bytes: a polynomial from prefix sums, then mixed with the length."""
    if starts.size == 0:
        return np.empty(0, np.uint64)
    size = 1 << max(16, int(buf.size).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(buf.size + 1, np.uint64)
    np.cumsum(_TABLE[buf] * power[: buf.size], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= (ends - starts).astype(np.uint64) * _C[2]
    return mix(h)


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (anything but space and tab to carriage return) of some texts: (bytes, starts, ends, text index)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends = spans(~_SPACE[buf])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return buf, starts, ends, np.searchsorted(bounds, starts, "right")


def shingles(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every window of `size` words that lies in one text."""
    n = hashes.size - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, owner.dtype)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h += hashes[i : i + n] * _C[i % 10]
        h ^= h >> _S2
        h *= _C[(i + 3) % 10]
    keep = owner[:n] == owner[size - 1 :]
    return mix(h)[keep], owner[:n][keep]


def text_parts(column, limit: int = 1 << 19):
    """The texts of an Arrow column as UTF-8 (null: empty), in lists of about `limit` bytes, one text at least."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()))
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes + 1) // limit)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for i, j in zip(cuts, cuts[1:]):
        yield [(t or "").encode("utf-8", "surrogatepass") for t in column.slice(i, j - i).to_pylist()]


def blocks(texts: list[bytes], limit: int = 1 << 19):
    """Index ranges of texts whose joint length stays near `limit` bytes."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield first, i
            first, total = i, 0
        total += len(t) + 1
    if first < len(texts):
        yield first, len(texts)
