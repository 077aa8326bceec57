"""Inventory of a source tree: which files there are, in which language, and which are read."""

from __future__ import annotations

import fnmatch
import os
from functools import reduce

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findinglake.functions.columns import lookup
from findinglake.storage import written

# Languages by extension, endings that are never text, and default exclusions.
LANGUAGES = {
    ".py": "python", ".pyw": "python",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".php": "php", ".phtml": "php", ".php3": "php", ".php4": "php", ".php5": "php", ".php7": "php", ".phps": "php",
    ".java": "java", ".cs": "csharp", ".go": "go",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c++": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".h": "cpp",
    ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".rs": "rust", ".dart": "dart", ".scala": "scala",
}
BINARY_ENDINGS = [
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".webp", ".bmp", ".pdf", ".woff", ".woff2", ".ttf", ".otf", ".eot", ".mp3", ".mp4", ".mov", ".avi",
    ".wav", ".so", ".dll", ".exe", ".dylib", ".bin", ".class", ".pyc", ".pyo", ".o", ".a", ".sqlite", ".db", ".pt", ".pth", ".onnx",
    ".safetensors", ".h5", ".pkl", ".npy", ".npz", ".parquet",
    ".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".jar", ".war", ".ear", ".whl", ".egg", ".apk", ".nupkg",
]
EXCLUDES = [
    ".git/", ".hg/", ".svn/", "node_modules/", "bower_components/", "vendor/", ".venv/", "venv/", "env/", "__pycache__/", ".mypy_cache/",
    ".pytest_cache/", ".ruff_cache/", ".tox/", "dist/", "build/", ".next/", ".nuxt/", "coverage/", "target/", "site-packages/", ".idea/",
    ".vscode/", "*.min.js", "*.min.css", "*.map", "*.bundle.js",
]
HEAD = 8192


_NAMES = "path string, size long, folder boolean"


def _listed(root: str):
    """Lists folders (column path, relative to root): each entry's path and size, and whether it is a folder.  Links to
    either are left out."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            for folder in pdf["path"]:
                entries = fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base))
                kinds = (pafs.FileType.File, pafs.FileType.Directory)
                own = [e for e in entries if e.type in kinds and not (fs.type_name == "local" and os.path.islink(e.path))]
                for at in range(0, len(own), 10_000):
                    rows = [(e.path[len(base) :].lstrip("/"), e.size, e.type == pafs.FileType.Directory) for e in own[at : at + 10_000]]
                    yield pd.DataFrame(rows, columns=["path", "size", "folder"]).astype({"size": "Int64"})

    return run


def tree_names(spark: SparkSession, root: str, slices: int = 64) -> DataFrame:
    """path and size of every regular file below root, hidden ones as well.

    Folders are listed level by level: what one level finds is written, and its folders are spread over tasks again, so
    a tree with one top folder is listed by as many tasks as it has folders in a level.
    """
    level, names = spark.createDataFrame([("",)], "path string"), []
    while True:
        found = written(level.mapInPandas(_listed(root), _NAMES))
        names.append(found.where("not folder").select("path", "size"))
        below = found.where("folder").select("path")
        n = below.count()
        if not n:
            return reduce(DataFrame.unionByName, names)
        level = below.repartition(max(1, min(slices, n)), "path")


def read_tree(spark: SparkSession, root: str, max_bytes: int = 1 << 20, slices: int = 64) -> DataFrame:
    """path (relative to root), size and content of every regular file below root, hidden and empty ones as well
    (Spark's binaryFile source leaves those out); links aren't followed, contents above max_bytes are null.

    root is a path or URI that all executors can read.  Names are spread by hash, and tasks read the contents file by file.
    """

    def contents(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for pdf in batches:
            for path, size in zip(pdf["path"], pdf["size"]):
                with fs.open_input_stream(f"{base}/{path}") as f:
                    yield pd.DataFrame({"path": [path], "size": [size], "content": [f.read() if size <= max_bytes else None]})

    return tree_names(spark, root, slices).repartition(slices, "path").mapInPandas(contents, "path string, size long, content binary")


def extension(path: Column) -> Column:
    """The last name's ending from its last dot, lower case; names that only start with dots have none."""
    return F.lower(F.regexp_extract(F.regexp_extract(path, "[^/]*$", 0), r"^\.*[^.].*(\.[^.]*)$", 1))


def language(path: Column, head: Column) -> Column:
    """Language by extension, else by `<?php` in .inc files, else by a `#!` line; null if unknown."""
    text = F.decode(head, "ISO-8859-1")
    ext, first = extension(path), F.split_part(text, F.lit("\n"), F.lit(1))
    known = F.nullif(lookup(ext, LANGUAGES, ""), F.lit(""))
    bang = F.when(first.contains("python"), "python").when(first.contains("node"), "javascript").when(first.contains("php"), "php")
    return F.coalesce(known, F.when((ext == ".inc") & text.rlike(r"^\s*<\?php"), "php"), F.when(text.startswith("#!"), bang))


def is_binary(head: Column) -> Column:
    """A NUL byte, or over 30 % control bytes, in the first 8192 bytes."""
    text = F.decode(F.substring(head, 1, HEAD), "ISO-8859-1")
    n = F.length(text)
    return F.coalesce(text.contains("\x00") | (n - F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0e-\\x1f]", "")) > 0.3 * n), F.lit(False))


def excluded(path: Column, patterns: list[str] = EXCLUDES) -> Column:
    """`name/` leaves out folders of that name, `a/b/` that folder (globs allowed), other globs names or whole paths."""
    regex = lambda p: fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$").replace("(?s:", "(?:")
    folders = F.concat(F.lit("/"), F.regexp_extract(path, "^(.*/)[^/]*$", 1))
    name, out = F.regexp_extract(path, "[^/]*$", 0), F.lit(False)
    for p in patterns:
        if not p.endswith("/"):
            out = out | name.rlike(f"(?s)^{regex(p)}") | path.rlike(f"(?s)^{regex(p)}")
        elif "/" not in p[:-1]:
            out = out | folders.contains(f"/{p}")
        else:
            body = regex(p[:-1])[:-1]
            out = out | path.rlike(f"(?s)^{body}/")
    return F.coalesce(out, F.lit(False))


def inventory(files: DataFrame, patterns: list[str] = EXCLUDES, max_bytes: int = 1 << 20) -> DataFrame:
    """path, size, language, status, lines and sha256 of each file (path, size, content).

    status is the first that holds: EXCLUDED, SKIPPED_BINARY by ending, SKIPPED_SIZE, SKIPPED_BINARY by content,
    ANALYZED.  lines and sha256 are of analysed files only; an empty or null content counts as an empty file.
    """
    content = F.coalesce("content", F.lit(b""))
    head = F.substring(content, 1, HEAD)
    status = F.when(excluded(F.col("path"), patterns), "EXCLUDED").when(extension(F.col("path")).isin(BINARY_ENDINGS), "SKIPPED_BINARY")
    status = status.when(F.col("size") > max_bytes, "SKIPPED_SIZE").when(is_binary(head), "SKIPPED_BINARY").otherwise("ANALYZED")
    rows = files.select("path", "size", content.alias("content"), language(F.col("path"), head).alias("language"), status.alias("status"))
    text = F.decode("content", "ISO-8859-1")
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = ((F.length(text) > 0) & ~text.endswith("\n")).cast("int")
    read = F.col("status") == "ANALYZED"
    return rows.select("path", "size", "language", "status", F.when(read, breaks + open_end).alias("lines"), F.when(read, F.sha2("content", 256)).alias("sha256"))


def capped(files: DataFrame, most: int = 20_000) -> DataFrame:
    """The first `most` files by path (a limit that is the feature); a top-k without a global sort."""
    return files.orderBy("path").limit(most)


def archive_paths(entries: DataFrame) -> DataFrame:
    """entries (archive, path) with name: the path without the one top folder that all of an archive's paths share."""
    top = F.regexp_extract("path", "^([^/]*)/", 1)
    per = entries.groupBy("archive").agg(F.min(top).alias("low"), F.max(top).alias("high"), F.every(F.col("path").contains("/")).alias("deep"))
    shared = F.when(F.col("deep") & (F.col("low") == F.col("high")), F.length("low") + 2).otherwise(1)
    return entries.join(per.select("archive", shared.alias("from")), "archive").withColumn("name", F.expr("substring(path, from)")).drop("from")
