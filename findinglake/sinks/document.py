"""One document out of many rows: a data source whose tasks write ordered ranges, which the commit joins.

A document has numbered sections; each is a text that opens it, rows with a separator between them, and a text that
closes it.  Rows are put in order by ranges, so that task i holds what comes before task i + 1.  A task writes its rows
to files of its own in a staging folder, one for each section; only files of committed attempts are joined, in order,
by streaming copies into a temporary file that is then moved to its place.  No task or driver holds the document, a
task that is repeated leaves nothing behind in it, and a job that fails leaves no document.

Files are opened by pyarrow's file systems (local or shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import RecordBatch
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "finding_document"
_CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its place in the order, and (section, file, rows) of each of its files."""

    partition: int
    files: list[tuple[int, str, int]] = field(default_factory=list)


def _open(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, layout: list[dict], staging: str):
        self.path, self.layout, self.staging = path, layout, staging

    def write(self, iterator: Iterator[RecordBatch]) -> Written:
        """Rows (section, text), sorted by section, to one file for each section."""
        store, folder = _open(self.staging)
        store.create_dir(folder, recursive=True)
        out = Written(TaskContext.get().partitionId())
        attempt, file, section, rows = uuid.uuid4().hex, None, None, 0

        def end() -> None:
            if file is not None:
                file.close()
                out.files.append((section, name, rows))

        try:
            for batch in iterator:
                for at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if at != section:
                        end()
                        name = f"{folder}/{out.partition:08d}-{at:04d}-{attempt}"
                        file, section, rows = store.open_output_stream(name), at, 0
                    file.write(((self.layout[at]["separator"] if rows else "") + (text or "")).encode("utf-8", "replace"))
                    rows += 1
            end()
        except BaseException:
            if file is not None and not file.closed:
                file.close()
            raise
        return out

    def commit(self, messages: list[Written | None]) -> None:
        store, target = _open(self.path)
        half = f"{target}.{uuid.uuid4().hex}"
        store.create_dir(target.rsplit("/", 1)[0], recursive=True)
        parts = sorted((section, m.partition, name) for m in messages if m for section, name, _ in m.files)
        with store.open_output_stream(half) as out:
            for section, told in enumerate(self.layout):
                out.write(told["open"].encode())
                own = [name for s, _, name in parts if s == section]
                for i, name in enumerate(own):
                    if i:
                        out.write(told["separator"].encode())
                    with store.open_input_stream(name) as source:
                        while data := source.read(_CHUNK):
                            out.write(data)
                out.write(told["close"].encode())
        store.move(half, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = _open(self.staging)
        if store.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            store.delete_dir(folder)


class DocumentSink(DataSource):
    """Options: path, layout (JSON: list of open, separator, close).  Rows: section int, text string."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        if [f.name for f in schema.fields] != ["section", "text"]:
            raise ValueError("a document's rows are (section, text)")
        path = self.options["path"]
        if not overwrite:
            store, target = _open(path)
            if store.get_file_info(target).type != arrow_fs.FileType.NotFound:
                raise FileExistsError(path)
        return DocumentWriter(path, json.loads(self.options["layout"]), f"{path}.parts-{uuid.uuid4().hex}")


def section(open_: str = "", separator: str = ",\n", close: str = "") -> dict:
    return {"open": open_, "separator": separator, "close": close}


def write_document(rows: DataFrame, path: str, layout: list[dict], order: list[str], overwrite: bool = True) -> str:
    """Writes rows (section, text, and the columns of `order`) as one document; the path.

    Sections without rows are their opening and closing texts only; a null text is an empty one.  Rows equal in section
    and order stand in any order.
    """
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSink)
    keys = ["section", *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("text", *keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("section", "text")
    writer = placed.write.format(NAME).mode("overwrite" if overwrite else "append")
    writer.option("path", path).option("layout", json.dumps(layout)).save()
    return path
