"""Closures of graphs that don't fit one task: a semi-naive loop over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of the machine's own only in local mode, where both are one process."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="sievelight-")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """`node` of all nodes that (src, dst) edges reach from seeds (node), cycles included.

    The edges are written once, however dear they are to make. Each round joins only the last round's new nodes and writes its own
    to the shared folder, which cuts the lineage and outlives lost executors; it ends with a round that finds nothing new.
    """
    spark = edges.sparkSession
    root = f"{shared_dir(spark)}/closure-{uuid.uuid4().hex}"
    edges.select("src", "dst").where("src is not null and dst is not null").distinct().write.parquet(f"{root}/edges")
    edges = spark.read.parquet(f"{root}/edges")
    k = 0
    seeds.select("node").where("node is not null").distinct().write.parquet(f"{root}/round=0")
    while True:
        known = spark.read.parquet(*[f"{root}/round={i}" for i in range(k + 1)])
        fresh = spark.read.parquet(f"{root}/round={k}")
        new = edges.join(fresh, edges.src == fresh.node).select(edges.dst.alias("node")).where("node is not null").distinct().join(known, "node", "left_anti")
        k += 1
        new.write.parquet(f"{root}/round={k}")
        if spark.read.parquet(f"{root}/round={k}").isEmpty():
            return known.select("node")


def kept(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The frame, written to the shared folder and read back; a folder for each value of `by`."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The written rounds of a semi-naive loop; every `merge` rounds those before become one table, so that a round opens few files."""

    def __init__(self, spark: SparkSession, name: str, merge: int = 16):
        self.spark, self.merge, self.root = spark, merge, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        self.n = 0

    def add(self, rows: DataFrame) -> DataFrame:
        """Writes a round and gives it back."""
        self.schema, path = rows.schema, f"{self.root}/round={self.n}"
        rows.write.parquet(path)
        self.n += 1
        if len(self.tables) >= self.merge:
            self.known().write.parquet(f"{self.root}/merged={self.n}")
            self.tables = [f"{self.root}/merged={self.n}"]
        self.tables.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def known(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.tables)


def ways(edges: DataFrame, seeds: DataFrame, on: list[str], of: list[str] | None = None) -> DataFrame:
    """`of` and `on` columns, node, way: what edges (on, src, dst) reach from seeds (on, of, node), and the nodes of a shortest way to it, the seed
    first; of several the first in order. Each round joins the last round's nodes with the edges, and drops what is known."""
    keys = [*on, *(of or [])]
    steps = kept(edges.select(*on, "src", "dst"), "edges").withColumnRenamed("src", "node")
    rounds = Rounds(edges.sparkSession, "ways")
    fresh = rounds.add(seeds.select(*keys, "node").distinct().withColumn("way", F.array("node")))
    while not fresh.isEmpty():
        step = fresh.join(steps, [*on, "node"]).select(*keys, F.col("dst").alias("node"), F.concat("way", F.array("dst")).alias("way"))
        new = step.groupBy(*keys, "node").agg(F.min("way").alias("way"))
        fresh = rounds.add(new.join(rounds.known().select(*keys, "node"), [*keys, "node"], "left_anti"))
    return rounds.known()
