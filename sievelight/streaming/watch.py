"""Watching a folder of source tables: the batch scan as a stream, the latest version of each file, debounced edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import Catalog
from ..operators.file_rules import file_scan
from .newest import newest, started

EDITS = "path string, language string, text string, version long, at timestamp"


def edits(spark: SparkSession, folder: str, schema: str = EDITS, most_files: int = 1000) -> DataFrame:
    """New Parquet files of (path, language, text, version, at) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(folder)


def scan_stream(stream: DataFrame, catalog: Catalog | None = None) -> DataFrame:
    """Findings of each file that arrives; the scan is stateless, so the same plan as the batch one."""
    return file_scan(stream, catalog)


def debounced(stream: DataFrame, gap: str = "800 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last version of each burst of edits: a session window for each path, whose state the watermark drops."""
    g = stream.withWatermark("at", late).groupBy("path", F.session_window("at", gap))
    return g.agg(F.max_by("text", "version").alias("text"), F.max("version").alias("version"), F.max_by("language", "version").alias("language")).select("path", "language", "text", "version")


def latest_only(batch: DataFrame) -> DataFrame:
    """Of several versions of a file within one batch only the last."""
    return batch.groupBy("path").agg(F.max(F.struct("version", "language", "text")).alias("x")).select("path", "x.language", "x.text", "x.version")


def watch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, catalog: Catalog | None = None, stale: bool = False):
    """Runs the scan on what is newer than all batches before gave; `sink(findings, batch_id)` must be idempotent by batch.

    With `stale` each batch is taken by itself: only its own older versions are dropped, and no state is kept."""
    own = stream if stale else newest(stream)
    writer = own.writeStream.outputMode("append" if stale else "update").foreachBatch(lambda df, i: sink(file_scan(latest_only(df), catalog), i)).option("checkpointLocation", checkpoint)
    return started(stream.sparkSession, writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second"))
