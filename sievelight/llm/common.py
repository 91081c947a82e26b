"""What the operators of this subpackage share: scratch tables, batches, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of the machine's own only in local mode, where both are one process."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d
    master = spark.sparkContext.master
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="sievelight-")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    `drop` removes a table as soon as what was made of it is itself written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Removes tables; a name may be a pattern."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            fs = path.getFileSystem(conf)
            for found in fs.globStatus(path) or []:
                fs.delete(found.getPath(), True)


def by_rows(
    batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], list[int]], most: int
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `most` units each, one row at least, so that memory has a bound."""
    for b in batches:
        start, total = 0, 0
        for i, n in enumerate(size(b)):
            if i > start and total + n > most:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if b.num_rows > start:
            yield b.slice(start)
        pa.default_memory_pool().release_unused()  # workers stay: what the pool keeps is lost to the next stage


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of texts; a null is an empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def text_sizes(name: str = "text") -> Callable[[pa.RecordBatch], list[int]]:
    import pyarrow.compute as pc

    return lambda b: pc.fill_null(pc.binary_length(b.column(name)), 0).to_pylist()


def numbered(df: DataFrame, keys: list[str], order: Column, ties: list[Column], name: str, parts: int = 256) -> DataFrame:
    """`name`: the rank from 0 of each row among those with equal `keys` (no nulls), by the 64-bit `order`, then `ties`.

    A hot key is dealt over `parts` ranges of `order`; the ranges' counts, at most `parts` for a key, give
    each range its first rank. `order` should be a hash, so that the ranges are even.
    """
    part, by, before, n = (f"_{name}_{x}" for x in ("part", "by", "before", "n"))
    dealt = df.withColumn(by, order).withColumn(part, F.floor(F.col(by) / F.lit(2.0**64 / parts)).cast("int"))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, part).agg(F.count("*").alias(n))
    counts = counts.select(*keys, part, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    inner = F.row_number().over(Window.partitionBy(*keys, part).orderBy(by, *ties)) - 1
    ranked = dealt.withColumn(name, inner).join(counts, [*keys, part])
    return ranked.withColumn(name, F.col(name) + F.col(before)).drop(before, part, by)


def firsts(groups: DataFrame, part: Column, order: list[Column], count: str, name: str) -> DataFrame:
    """`name`: the rows before each group in the order (`part`, *order), where a group stands for `count` rows.

    `part` deals the order into ranges, whose number the caller bounds: their counts are summed up in one task and joined to all.
    """
    dealt = groups.withColumn("_part", part)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum(count).alias("_all"))
    sums = sums.select("_part", F.coalesce(F.sum("_all").over(before(Window.orderBy("_part"))), F.lit(0)).alias("_before"))
    inner = F.coalesce(F.sum(count).over(before(Window.partitionBy("_part").orderBy(*order))), F.lit(0))
    return dealt.withColumn("_inner", inner).join(F.broadcast(sums), "_part").withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_before", "_inner")


def copies(groups: DataFrame, count: str, name: str, chunk: int) -> DataFrame:
    """A row for each of a group's `count` rows, numbered from 0 by `name`; a group of more than `chunk` rows is dealt to several tasks."""
    upto = lambda low, high: F.explode(F.sequence(low, high - 1))
    none, n = F.lit(0).cast("long"), F.col(count)
    few = groups.where(n <= chunk).withColumn(name, upto(none, n))
    many = groups.where(n > chunk).withColumn("_chunk", upto(none, F.ceil(n / chunk)))
    many = many.repartition(F.xxhash64("_chunk", *groups.columns)).withColumn(name, upto(F.col("_chunk") * chunk, F.least(n, (F.col("_chunk") + 1) * chunk)))
    return few.unionByName(many.drop("_chunk"))
