"""A sink for one document of any size: tasks write ordered fragments, the commit joins head, fragments and tail.

Two phases: a task's fragment counts only with its commit message, so those of failed or repeated tasks are left out; the joined document gets
its name by a rename once it is whole; an aborted job leaves neither document nor fragments. Rows keep the order of the frame's partitions, and
no process holds more than a buffer of it. The target must be a path that driver and executors share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .stores import opened

BUFFER = 8 << 20


@dataclass
class Fragment(WriterCommitMessage):
    partition: int
    name: str
    rows: int


class OneDocument(DataSource):
    """Options: path, head, tail, between; the frame's first column is the document's pieces, nulls are left out."""

    @classmethod
    def name(cls) -> str:
        return "one_document"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return DocumentWriter(dict(self.options))


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.head, self.tail, self.between = low["path"], low.get("head", ""), low.get("tail", ""), low.get("between", "\n")
        self.parts = f"{self.path.rstrip('/')}.parts-{low['run']}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Fragment:
        task = TaskContext.get()
        store, folder = opened(self.parts)  # not made here: a task that outlives an aborted job must not bring it back
        name, rows = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with store.open_output_stream(name, buffer_size=BUFFER) as out:
            for b in batches:
                for piece in b.column(0):
                    if piece.is_valid:
                        out.write(((self.between if rows else "") + piece.as_py()).encode())
                        rows += 1
        return Fragment(task.partitionId(), name, rows)

    def commit(self, messages: list[Fragment | None]) -> None:
        store, whole = opened(self.path)
        made, first = f"{opened(self.parts)[1]}.whole", True
        with store.open_output_stream(made, buffer_size=BUFFER) as out:
            out.write(self.head.encode())
            for m in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
                if not first:
                    out.write(self.between.encode())
                first = False
                with store.open_input_stream(m.name) as part:
                    while piece := part.read(BUFFER):
                        out.write(piece)
            out.write(self.tail.encode())
        store.move(made, whole)
        self._clear(store)

    def abort(self, messages: list[Fragment | None]) -> None:
        self._clear(opened(self.path)[0])

    def _clear(self, store: fs.FileSystem) -> None:
        folder = opened(self.parts)[1]
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


def write_document(pieces: DataFrame, path: str, head: str = "", tail: str = "", between: str = "\n") -> None:
    """The pieces (first column, in the frame's order) as one file, which it replaces."""
    pieces.sparkSession.dataSource.register(OneDocument)
    run = uuid.uuid4().hex
    store, folder = opened(DocumentWriter({"path": path, "run": run}).parts)
    store.create_dir(folder, recursive=True)
    # Nothing is there to be appended to: the sink replaces the file whole.
    pieces.write.format("one_document").mode("append").options(path=path, head=head, tail=tail, between=between, run=run).save()
