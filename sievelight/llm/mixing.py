"""Mixing sources to target weights: subset sums over exact document lengths.

1. Sizes are numbers of words. Per source only its size is gathered: `targets` shares the total by weight in one
   pass over the sources, those that saturate first (three times their size over their weight) ahead:
   water filling, in integers up to one final division.
2. A source takes each document floor(target / size) times. The rest of its budget is fitted over its histogram of exact
   lengths, a row for each distinct length, never for each document: each length gets its share of
   the rest, rounded down; documents of the longest lengths are added until the rest is at most twice the longest
   length; a bounded-knapsack dynamic program over lengths, the short ones first, meets it, or comes nearest.
3. Of each length the documents with the least seeded hashes are taken once more, by `common.numbered`, which deals a hot
   (source, length) over many tasks. Reruns agree, as nothing depends on partitions.

Defined cases: a null or empty text has size 0 and is taken 0 times; sources without words have target 0; a
null source is a source of its own, the last one; documents of equal hash are ordered by id, and equal
rows are taken row by row; a null id stays null. Extra columns are kept by `mix`. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, numbered


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (5, 2, 1)
    most: int = 3
    seed: int = 5


def targets(sizes: DataFrame, s: Settings = Settings()) -> DataFrame:
    """source, source_size, target from (source, source_size); one row for each source, so one task orders them."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    weight = F.element_at(F.array(*map(F.lit, s.weights)), (rank % len(s.weights) + 1).cast("int")).cast("long")
    ranked = sizes.select("source", "source_size", weight.alias("weight"), rank.alias("rank"))
    # With those before it at their limit, a source is at its own if the share of the rest would exceed it.
    full = Window.orderBy(F.col("source_size") * s.most / F.col("weight"), "rank")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    taken, left = F.coalesce(F.sum(F.col("source_size") * s.most).over(before), F.lit(0)), F.sum("weight").over(after)
    total = F.sum("source_size").over(every)
    seen = ranked.select("*", (total - taken).alias("rest"), left.alias("left"))
    capped = F.col("rest") * F.col("weight") >= F.col("source_size") * s.most * F.col("left")
    seen = seen.withColumn("capped", capped)
    # The share of the first that isn't at its limit holds for all after it.
    free = [F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") * s.most / F.col("weight"), "rank", "rest", "left"))).over(every).alias("free")]
    seen = seen.select("*", *free)
    share = (F.col("weight") * F.col("free.rest")).cast("double") / F.col("free.left").cast("double")
    return seen.select("source", "source_size", F.when(F.col("capped"), (F.col("source_size") * s.most).cast("double")).otherwise(share).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length (rising, above 0) to take, so that their words come nearest to the budget."""
    total = int((lengths * counts).sum())
    if total == 0 or budget <= 0:
        return np.zeros(len(lengths), np.int64)
    if budget >= total:
        return counts.copy()
    want = int(round(budget))
    taken = np.array([int(c) * want // total for c in counts], np.int64)
    left = want - int((lengths * taken).sum())
    for i in range(len(lengths) - 1, -1, -1):
        spare = left - 2 * int(lengths[-1])
        if spare <= 0:
            break
        n = min(int(counts[i] - taken[i]), spare // int(lengths[i]))
        taken[i] += n
        left -= n * int(lengths[i])
    # The dynamic program: bit x of a number says that the sum x can be made. It ends once the budget can be met.
    most = left + int(lengths[-1])
    steps, sums, full = [], 1, (1 << most + 1) - 1
    for i in range(len(lengths)):
        n, k = min(int(counts[i] - taken[i]), most // int(lengths[i])), 1
        while n:
            k = min(k, n)
            steps.append((i, k, sums))
            sums |= sums << k * int(lengths[i]) & full
            n, k = n - k, 2 * k
        if sums >> left & 1:
            break
    below = (sums & (1 << left + 1) - 1).bit_length() - 1
    above = sums >> left
    above = left + (above & -above).bit_length() - 1 if above else below
    at = above if above - left < left - below else below
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += k
            at -= k * int(lengths[i])
    return taken


def _fitted(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("size")
    target, words = rows.column("target")[0].as_py(), rows.column("source_size")[0].as_py()
    whole = int(target // words)
    more = fit(rows.column("size").to_numpy(), rows.column("n").to_numpy(), target - whole * words)
    out = rows.select(["source", "size"]).append_column("whole", pa.array([whole] * len(more), pa.int64()))
    return out.append_column("more", pa.array(more, pa.int64()))


def mix(docs: DataFrame, s: Settings = Settings(), keep: Scratch | None = None) -> DataFrame:
    """The documents' other columns but the text, with size, source_size, target and times."""
    scratch = keep or Scratch(docs.sparkSession, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = scratch.keep(docs.drop("size", "source_size", "target", "times").withColumn("size", size).drop("text"), "sized")
    # A key that is never null: the source with a mark before it.
    known = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))
    counts = scratch.keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    shares = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), s)
    shares = scratch.keep(shares.withColumn("_source", known).drop("source"), "shares")
    # Histograms grow with the data, and so may sources: joins by hash, never by broadcast.
    rows = counts.where("size > 0").withColumn("_source", known).join(shares.hint("shuffle_hash"), "_source").select(F.col("_source").alias("source"), "size", "n", "source_size", "target")
    fitted = rows.groupBy("source").applyInArrow(_fitted, "source string, size long, whole long, more long")
    fitted = scratch.keep(fitted.withColumnRenamed("source", "_source").withColumnRenamed("size", "_size"), "fitted")
    order = F.xxhash64(F.lit(s.seed), "doc_id")
    ranked = numbered(sized.withColumn("_source", known).withColumn("_size", F.col("size")), ["_source", "_size"], order, [F.col("doc_id")], "_rank")
    out = ranked.join(fitted.hint("merge"), ["_source", "_size"], "left").join(shares.hint("merge"), "_source")
    times = F.coalesce(F.col("whole") + (F.col("_rank") < F.col("more")).cast("long"), F.lit(0))
    return out.withColumn("times", times).drop("_source", "_size", "_rank", "whole", "more")


def mixed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document."""
    out = mix(docs.select("doc_id", "text", "source"), s)
    return out.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
