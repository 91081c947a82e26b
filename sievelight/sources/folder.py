"""A source for folders of code that prunes before it lists and never opens what a scan doesn't want.

`PrunedFolder` is a data source: the driver lists folder by folder, several at a time, and doesn't enter skipped or ignored ones; files to
read are dealt to partitions by their bytes, so one large file doesn't hold up many small ones; tasks open those files and no others. It reads what
is local or mounted. `listed` gives the same files from any store by Hadoop's interface, to be loaded with Spark's own reader.

Defined results: a folder or file that goes away while it is listed is left out, as are links to folders (they could lead in circles); a file above
`max_bytes` has its row with a null content, so that nothing is lost silently and no task outgrows its memory; an empty file has an empty content.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import dims
from .stores import opened

SCHEMA = "path string, size long, content binary"
#: What opening a file costs, in bytes, when files are dealt to partitions.
OPEN_COST = 1 << 16
MAX_BYTES = 1 << 30


@dataclass(frozen=True)
class Rules:
    """What a scan reads below its target: known suffixes and build files, outside of skipped folders and of globs, which are matched against
    the path below the target, `*` over slashes."""

    ignore: tuple[str, ...] = ()
    recursive: bool = True

    def enters(self, folder: str) -> bool:
        name = folder.rsplit("/", 1)[-1]
        # A glob that ends in `*` and matches the folder with its slash matches all that lies below it.
        return self.recursive and name not in dims.SKIPPED_DIRS and not any(g.endswith("*") and fnmatch.fnmatchcase(folder + "/", g) for g in self.ignore)

    def reads(self, file: str) -> bool:
        name = file.rsplit("/", 1)[-1]
        dot = name.rfind(".")
        known = name.lower() in dims.BUILD_FILES or (dot > 0 and name[dot:].lower() in dims.SUFFIXES)
        return known and not any(fnmatch.fnmatchcase(file, g) for g in self.ignore)


def walked(store: fs.FileSystem, top: str, rules: Rules, threads: int = 8) -> Iterator[tuple[str, int]]:
    """(path, size) of the files to read below `top`, level by level, each folder listed once."""

    def listing(folder: str) -> list[fs.FileInfo]:
        found = store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
        return [x for x in found if x.type == fs.FileType.File or (x.type == fs.FileType.Directory and not (isinstance(store, fs.LocalFileSystem) and os.path.islink(x.path)))]

    cut = len(top.rstrip("/")) + 1
    with ThreadPoolExecutor(threads) as pool:
        level = [top]
        while level:
            deeper = []
            for found in pool.map(listing, level):
                for x in sorted(found, key=lambda x: x.path):
                    own = x.path[cut:]
                    if x.type == fs.FileType.Directory:
                        if rules.enters(own):
                            deeper.append(x.path)
                    elif rules.reads(own):
                        yield x.path, x.size
            level = deeper


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def dealt(files: Iterator[tuple[str, int]], most: int) -> list[Files]:
    """Partitions of about `most` bytes, the cost of opening included; a larger file has one of its own."""
    out, own, total = [], [], 0
    for path, size in files:
        cost = size + OPEN_COST
        if own and total + cost > most:
            out.append(Files(own))
            own, total = [], 0
        own.append((path, size))
        total += cost
    return [*out, Files(own)] if own else out


class PrunedFolder(DataSource):
    """Options: path, ignore (globs as a JSON array), recursive, partition_bytes, max_bytes. A path to a file reads it, whatever its suffix."""

    @classmethod
    def name(cls) -> str:
        return "pruned_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        low = {k.lower(): v for k, v in options.items()}
        self.target = low["path"]
        self.rules = Rules(tuple(json.loads(low.get("ignore", "[]"))), low.get("recursive", "true").lower() == "true")
        self.most, self.max_bytes = int(low.get("partition_bytes", 32 << 20)), int(low.get("max_bytes", MAX_BYTES))

    def partitions(self) -> list[Files]:
        store, top = opened(self.target)
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.target)
        files = iter([(top, info.size)]) if info.type == fs.FileType.File else walked(store, top, self.rules)
        return dealt(files, self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.target)
        rows, total = [], 0
        for path, size in partition.files if partition else ():
            content = None
            if size <= self.max_bytes:
                try:
                    with store.open_input_stream(path) as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
            rows.append((named(self.target, path), size if content is None else len(content), content))
            total += len(content or b"")
            if total > 8 << 20:
                yield _batch(rows)
                rows, total = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "size", "content"])


def named(target: str, path: str) -> str:
    """The path as Spark's own file sources name it."""
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]+)://([^/]*)", target):
        return f"{m[1]}:{path}" if m[1] == "file" else f"{m[1]}://{m[2]}/{path.lstrip('/')}"
    return "file:" + path


def listed(spark: SparkSession, target: str, rules: Rules) -> list[tuple[str, int]]:
    """(path, size) of the files to read below each of the paths that the target, which may be a glob, stands for; of any store that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out, level = [], []
    for top in store.globStatus(path) or []:
        name = top.getPath().toString()
        if top.isFile():
            out.append((name, top.getLen()))
        else:
            level.append((top.getPath(), len(name) + 1))
    while level:
        deeper = []
        for folder, cut in level:
            for x in store.listStatus(folder):
                name = x.getPath().toString()
                if x.isDirectory():
                    if rules.enters(name[cut:]) and not (name.startswith("file:/") and os.path.islink(name[5:])):
                        deeper.append((x.getPath(), cut))
                elif rules.reads(name[cut:]):
                    out.append((name, x.getLen()))
        level = deeper
    return sorted(out)
