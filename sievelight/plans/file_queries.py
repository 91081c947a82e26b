"""Queries on what crosses the file system: a folder written from `documents` and read back pruned, a report written as one document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fixpoint import shared_dir
from ..sources import files, sinks, stores
from ..streaming import watch
from ..streaming.newest import newest, started
from .line_queries import FOUND, found, query


def _write_tree(batches, top: str):
    """Writes each (path, text) as a file below `top`; one row with the number of files a task."""
    import pyarrow as pa

    store, root = stores.opened(top)
    n, made = 0, set()
    for b in batches:
        for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
            folder = f"{root}/{path}".rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(f"{root}/{path}") as f:
                f.write(text.encode())
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


_PLACE = "CASE doc_id % 7 WHEN 0 THEN 'src/a' WHEN 1 THEN 'src/node_modules/b' WHEN 2 THEN 'lib.d/sub/c' WHEN 3 THEN 'vendor/x/d' WHEN 4 THEN '.git/e' ELSE 'f' END || CAST(doc_id AS {text}) || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.JS' WHEN 2 THEN '.bin' ELSE '.sql' END"


@query(f"SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.JS' THEN 'javascript' ELSE 'sql' END AS language, md5(coalesce(text, '')) AS md5 FROM (SELECT text, {_PLACE.format(text='VARCHAR')} AS path FROM documents) WHERE path NOT LIKE '%node_modules%' AND path NOT LIKE '%.git/%' AND path NOT LIKE 'vendor/%' AND path NOT LIKE '%.bin'")
def folder_source(spark, d) -> DataFrame:
    """Every document as a file of a tree, of which the source reads what a scan wants: no skipped or ignored folder, no unknown suffix."""
    top = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.expr(_PLACE.format(text="STRING")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    docs.mapInArrow(lambda it: _write_tree(it, top), "n long").write.format("noop").mode("overwrite").save()
    own = files.read_files(spark, top, ignore=("vendor/*",))
    return own.select(F.substring_index("path", top.split("/")[-1] + "/", -1).alias("path"), "language", F.md5("text").alias("md5"))


_RESULT = "ruleId string, level string, message struct<text: string>, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: bigint, startColumn: bigint>>>>"


@query(f"WITH {FOUND} SELECT rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, title, path, line_no FROM found")
def document_sarif(spark, d) -> DataFrame:
    """All findings as one SARIF file written by all tasks, and its results read back, a line each, by all tasks."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}.sarif"
    sinks.write_sarif(found(spark, d), path, "2020-01-01T00:00:00Z")
    line = F.from_json(F.regexp_replace("value", ",$", ""), _RESULT)
    own = spark.read.text(path).where(F.col("value").startswith('{"ruleId"')).select(line.alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return own.select(F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"), F.col("r.message.text").alias("title"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line_no"))


@query("SELECT 'u' || user_id AS path, max(event_id) AS version, true AS rising FROM events GROUP BY user_id")
def watch_newest(spark, d) -> DataFrame:
    """Versions of a file for each user, in three batches out of order, through the keyed state: the last that went out is the newest, and each was newer
    than those before."""
    root = f"{shared_dir(spark)}/newest-{uuid.uuid4().hex}"
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.lit("python").alias("language"), F.col("event_type").alias("text"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") * 7 % 3).alias("batch"))
    for batch in range(3):
        rows.where(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{root}/in")
        # As many state stores as there are shuffle partitions when a stream first runs; a restart keeps that number.
        stream = newest(watch.edits(spark, f"{root}/in")).select("path", "version")
        write = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/out/run={i}")
        started(spark, stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/ck").trigger(availableNow=True)).awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    one = out.groupBy("path").agg(F.max_by("version", "run").alias("version"), F.sort_array(F.collect_list(F.struct("run", "version"))).alias("all"))
    rising = F.forall(F.sequence(F.lit(1), F.size("all") - 1), lambda k: (F.size("all") == 1) | (F.col("all")[k]["version"] > F.col("all")[k - 1]["version"]))
    return one.select("path", "version", F.when(F.size("all") == 1, True).otherwise(rising).alias("rising"))
