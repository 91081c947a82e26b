"""A folder of code as a stream of changes: new, changed and deleted files, each told once, over restarts.

The driver lists the folder (pruned as `sources.folder` does) once a trigger and holds the listing against the last one. The difference gets
the next number and is written to `log` before Spark learns the number, which is the offset: a batch that is run again after a failure reads the same
differences from there. They are removed once Spark has committed a later batch. The log's folder must be one that outlives the driver.

Defined results: a file that changed twice between two listings is told once, with its last state; one that is new and gone between two is not told.
A file that goes before its content is read is left out of that batch, and its deletion is told by the next listing. Deleted files have null
content and the time at which they were last seen. Content is what is there when it is read: a file that changes meanwhile is told again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..functions import text as T
from ..sources.files import clean_text
from ..sources.folder import MAX_BYTES, Files, Rules, dealt, named, walked
from ..sources.stores import opened

SCHEMA = "path string, kind string, modified long, size long, content binary"
_SEEN = pa.schema([("path", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])
_CHANGES = pa.schema([("path", pa.string()), ("kind", pa.string()), ("modified", pa.int64()), ("size", pa.int64())])


class FolderChanges(DataSource):
    """Options: path, log, ignore (globs as a JSON array), recursive, partition_bytes, max_bytes."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangesReader(dict(self.options))


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.target, self.log = low["path"], low["log"]
        self.rules = Rules(tuple(json.loads(low.get("ignore", "[]"))), low.get("recursive", "true").lower() == "true")
        self.most, self.max_bytes = int(low.get("partition_bytes", 32 << 20)), int(low.get("max_bytes", MAX_BYTES))

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _numbers(self, kind: str) -> list[int]:
        store, log = opened(self.log)
        found = store.get_file_info(fs.FileSelector(log, allow_not_found=True))
        return sorted(int(m[1]) for x in found if (m := re.fullmatch(rf"{kind}-(\d+)\.parquet", x.base_name)))

    def _write(self, kind: str, n: int, rows: list[tuple], schema: pa.Schema) -> None:
        store, log = opened(self.log)
        store.create_dir(log, recursive=True)
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema) if rows else schema.empty_table()
        with store.open_output_stream(f"{log}/.{kind}-{n}") as out:
            pq.write_table(table, out)
        store.move(f"{log}/.{kind}-{n}", f"{log}/{kind}-{n}.parquet")

    def _rows(self, kind: str, n: int) -> list[tuple]:
        store, log = opened(self.log)
        with store.open_input_file(f"{log}/{kind}-{n}.parquet") as f:
            return list(zip(*[c.to_pylist() for c in pq.read_table(f).columns], strict=True))

    def _listing(self) -> dict[str, tuple[int, int]]:
        store, top = opened(self.target)
        paths = [p for p, _ in walked(store, top, self.rules)]
        return {x.path: (x.mtime_ns or 0, x.size) for x in store.get_file_info(paths) if x.type == fs.FileType.File}

    def latestOffset(self) -> dict:
        numbers = self._numbers("seen")
        n = numbers[-1] if numbers else 0
        before = {p: (m, s) for p, m, s in self._rows("seen", n)} if n else {}
        now = self._listing()
        rows = [(p, "changed" if p in before else "new", *x) for p, x in now.items() if before.get(p) != x]
        rows += [(p, "deleted", before[p][0], 0) for p in before.keys() - now.keys()]
        if not rows:
            return {"n": n}
        # The listing comes last: without it, the differences of a driver that died here are made anew under the same number.
        self._write("changes", n + 1, sorted(rows), _CHANGES)
        self._write("seen", n + 1, [(p, *x) for p, x in sorted(now.items())], _SEEN)
        store, log = opened(self.log)
        for old in numbers:
            store.delete_file(f"{log}/seen-{old}.parquet")
        return {"n": n + 1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        last: dict[str, tuple] = {}
        there: dict[str, bool] = {}  # before the first of these differences
        for n in range(start["n"] + 1, end["n"] + 1):
            for path, kind, *x in self._rows("changes", n):
                there.setdefault(path, kind != "new")
                last[path] = ("deleted" if kind == "deleted" else "changed" if there[path] else "new", *x)
        last = {p: x for p, x in last.items() if there[p] or x[0] != "deleted"}
        files = dealt(((p, x[2]) for p, x in sorted(last.items())), self.most)
        for part in files:
            part.files = [(p, *last[p]) for p, _ in part.files]
        return files

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = opened(self.target)
        for path, kind, modified, size in partition.files if partition else ():
            content = None
            if kind != "deleted" and size <= self.max_bytes:
                try:
                    with store.open_input_stream(path) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
            yield named(self.target, path), kind, modified, size, content

    def commit(self, end: dict) -> None:
        store, log = opened(self.log)
        for n in self._numbers("changes"):
            if n <= end["n"]:
                store.delete_file(f"{log}/changes-{n}.parquet")


def folder_edits(spark: SparkSession, target: str, log: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path, language, text, version, at, kind of the files below `target` that are new, changed or deleted, as a stream; a version is its
    file's time in nanoseconds."""
    spark.dataSource.register(FolderChanges)
    raw = spark.readStream.format("folder_changes").options(path=target, log=log, ignore=json.dumps(list(ignore))).load()
    at = F.timestamp_micros(F.floor(F.col("modified") / 1000).cast("long"))
    return raw.select("path", T.detect_language("path").alias("language"), clean_text("content").alias("text"), F.col("modified").alias("version"), at.alias("at"), "kind")
