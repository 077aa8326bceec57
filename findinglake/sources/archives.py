"""Members of zip and tar archives as rows, under limits that reject an archive as a whole.

Each archive is read in one task, as its format demands; archives of one table are read by all executors.  An archive
that breaks a rule gives one row with its error and no members.
"""

from __future__ import annotations

import gzip
import io
import lzma
import re
import stat
import string
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "archive string, path string, size long, content binary, note string, error string"
_TAR = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")


@dataclass(frozen=True)
class Limits:
    """Bounds of an upload; the defaults are those of the model."""

    files: int = 20_000
    total: int = 250 << 20
    file: int = 50 << 20
    ratio: int = 200


class Rejected(Exception):
    pass


def clean_member(name: str) -> str | None:
    """A member's path with forward slashes, without '.' parts; None if it is absolute or leaves the archive."""
    name = name.replace("\\", "/")
    parts = [p for p in name.split("/") if p not in ("", ".")]
    unsafe = "\0" in name or name.startswith("/") or re.match("[A-Za-z]:", name) or ".." in parts or not parts
    return None if unsafe else "/".join(parts)


def _read(source, declared: int, left: int, limits: Limits) -> bytes:
    """A member's bytes, never more than what it declares (and a kilobyte) or than the limits allow."""
    data = source.read(min(limits.file, left, declared + 1024) + 1)
    if len(data) > min(limits.file, left):
        raise Rejected("the extracted size is over the limit")
    if len(data) > declared + 1024:
        raise Rejected("a member is larger than it declares")
    return data


def _members(named: list[tuple], opened, limits: Limits, told: bool) -> Iterator[tuple]:
    """(path, size, content, note) of (member, path, declared size); a common top folder is cut off."""
    if len(named) > limits.files:
        raise Rejected(f"more than {limits.files} files")
    if sum(n for _, _, n in named) > limits.total:
        raise Rejected("the extracted size is over the limit")
    tops = {p.split("/", 1)[0] for _, p, _ in named}
    cut = len(next(iter(tops))) + 1 if len(tops) == 1 and all("/" in p for _, p, _ in named) else 0
    left, seen = limits.total, set()
    for member, path, declared in named:
        path = path[cut:]
        if path in seen:
            if told:
                yield path, None, None, "duplicate entry"
            continue
        source = opened(member)
        if source is None:
            continue
        seen.add(path)
        with source:
            data = _read(source, declared, left, limits)
        left -= len(data)
        yield path, len(data), data, None


def _safe(name: str) -> str:
    path = clean_member(name)
    if path is None:
        raise Rejected(f"unsafe path: {name[:200]}")
    return path


def _zip(data: bytes, limits: Limits) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        named = []
        for info in archive.infolist():
            kind = stat.S_IFMT(info.external_attr >> 16)
            if info.is_dir():
                continue
            if kind not in (0, stat.S_IFREG):
                yield info.filename, None, None, "not a regular file"
                continue
            named.append((info, _safe(info.filename), info.file_size))
        for info, _, size in named:
            if info.compress_size and size > 1 << 20 and size > limits.ratio * info.compress_size:
                raise Rejected("suspicious compression ratio")
        yield from _members(named, archive.open, limits, True)


def _tar(data: bytes, limits: Limits) -> Iterator[tuple]:
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as archive:
        named = []
        for n, member in enumerate(archive):
            if n >= 2 * limits.files:
                raise Rejected(f"more than {limits.files} files")
            if member.isdir():
                continue
            if not member.isfile():
                yield member.name, None, None, "not a regular file"
                continue
            named.append((member, _safe(member.name), member.size))
        yield from _members(named, archive.extractfile, limits, False)


def _single(name: str, data: bytes, limits: Limits) -> Iterator[tuple]:
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    signs = set(string.ascii_letters + string.digits + "._- ")  # a hidden file is taken, as .env is what a search for secrets is for
    if not base or base in (".", "..") or len(base) > 200 or not signs.issuperset(base):
        raise Rejected("invalid file name")
    if len(data) > limits.file:
        raise Rejected("the file is over the limit")
    yield base, len(data), data, None


_BROKEN = (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, lzma.LZMAError, gzip.BadGzipFile, NotImplementedError, RuntimeError, ValueError)


def unpacked(name: str, data: bytes, limits: Limits) -> list[tuple]:
    """Rows of SCHEMA without the first column: members, or one row with an error; chosen by the name's ending."""
    low = name.lower()
    try:
        if low.endswith(".zip"):
            rows = _zip(data, limits)
        elif low.endswith(_TAR):
            rows = _tar(data, limits)
        else:
            rows = _single(name, data, limits)
        return [(*r, None) for r in rows]
    except Rejected as e:
        return [(None, None, None, None, str(e))]
    except _BROKEN:
        return [(None, None, None, None, "not a valid archive")]


def read_uploads(uploads: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of SCHEMA for uploads (name, content): each member of zip and tar archives, or the file itself.

    Paths that are absolute, have a drive letter, '..' or NUL, too many or too large files, and high compression
    ratios reject the archive.  Links and devices are left out with a note, repeated paths too (in tars without one).
    A null name or content is no valid archive.  Equal uploads give equal rows.
    """

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["content"]):
                ok = isinstance(name, str) and data is not None
                rows = unpacked(name, bytes(data), limits) if ok else [(None, None, None, None, "not a valid archive")]
                yield pd.DataFrame([(name, *r) for r in rows], columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])

    return uploads.select("name", "content").mapInPandas(run, SCHEMA)


def read_folder(spark, folder: str, limits: Limits = Limits()) -> DataFrame:
    """read_uploads of all files below a folder, by any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return read_uploads(files.select(F.col("path").alias("name"), "content"), limits)
