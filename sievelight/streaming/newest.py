"""The newest version of each file over all batches of a stream: keyed state that drops what comes late and forgets what rests.

A path's state is the version that went out last. Of a batch's rows the newest goes out if it is newer than that; older and equal ones are
dropped, in whatever order and batch they come. State that nothing has touched for `rest` expires, so its size follows the files being
edited, not all files ever seen; a version that comes after that counts as the first. State is written with the stream's checkpoint.

Nulls: a null version is older than all and goes out only where no version is known; a null path is a path like any. Equal newest versions in
a batch: the row with the greatest text goes out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NONE = -(1 << 63)
#: Rows cross to Python and back as one text, as pandas has no whole numbers with nulls; times keep their microseconds.
FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def _newer(rest_ms: int) -> Callable:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for b in batches:
            best = max([*zip(b["age"].tolist(), b["text"].fillna("").tolist(), b["row"].tolist(), strict=True), *([best] if best else [])])
        state_age = state.get[0] if state.exists else None
        if state_age is None or best[0] > state_age:
            state.update((best[0],))
            yield pd.DataFrame({"row": [best[2]]})
        state.setTimeoutDuration(rest_ms)

    return step


def newest(stream: DataFrame, rest_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """The stream's rows (path, text, version, ...) that are newer than all that came before for their path."""
    packed = stream.select("path", F.coalesce("version", F.lit(NONE)).alias("age"), "text", F.to_json(F.struct(*stream.columns), FORMAT).alias("row"))
    out = packed.groupBy("path").applyInPandasWithState(_newer(rest_ms), "row string", "age long", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.from_json("row", stream.schema, FORMAT).alias("r")).select("r.*")


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def started(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Starts a stream with `newest` in it, without batches that bring no data: Spark would run these one after another for the sake of
    timeouts, and a run of what is available would never end. State expires with the next batch that brings data."""
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")  # a stream takes a copy of the session's settings as it starts
    try:
        return writer.start()
    finally:
        spark.conf.set(NO_DATA, before)
