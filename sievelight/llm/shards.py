"""Sharding: a Feistel permutation of global row numbers, whose places give every row its shard and its slot there.

Rows are numbered 0 to n-1 in the order of a hash of the columns `by`, so that a number depends on the rows alone, not on files or
tasks. The permutation works on pairs of digits (number div b, number mod b) with a * b >= n: rounds add a keyed hash of one digit to the
other, and a result that is n or more is permuted again until one below n comes (cycle walking). Fewer than `a` results lie outside
and a walk meets none of them twice, so that many steps always suffice. Place p lies in shard p mod shards, at slot p div shards: shards
differ by a row at most, slots have no gap, and `permuted` and `restored` compute place from number and number from place.

Only DataFrame functions: equal rows are counted before any shuffle, ranges of the hash (at most `parts`) are numbered each by
itself, and a range's first number comes from the ranges' counts. A row that occurs often is dealt out in chunks of its copies.

Nulls: a null text counts as empty, other nulls are values like any. Empty texts: size 8. Repeated rows: all placed, each at its own
slot; which of two equal rows is which nobody can tell. Ties of the hash: by the columns. An empty table: no rows. Other columns of any name
travel in the struct `row`; their types must be ones that Spark can group by (no maps).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, copies, firsts


@dataclass(frozen=True)
class Settings:
    shards: int = 24
    seed: int = 13
    rounds: int = 6
    #: Ranges of the hash, a power of 16.
    parts: int = 4096
    #: Copies of one row that a task deals out at most.
    chunk: int = 65536


def sides(n: int) -> tuple[int, int]:
    """The numbers of values of the two digits: a * b >= n, less than a above it."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def hashed(*parts: Column) -> Column:
    """60 bits of a digest of the parts, as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _network(x: Column, n: int, s: Settings, back: bool) -> Column:
    """One pass of the rounds, or of their inverses, over the pairs of digits."""
    a, b = sides(n)
    mod = lambda v, m: F.pmod(v, F.lit(m).cast("long"))
    sign = F.lit(-1 if back else 1)
    left = lambda p, i: mod(p["l"] + sign * hashed(F.lit(s.seed), i, p["r"]), a)
    right = lambda p, i: mod(p["r"] + sign * hashed(F.lit(s.seed), i, p["l"]), b)
    step = lambda p, i: F.when(i % 2 == 0, F.struct(left(p, i).alias("l"), p["r"].alias("r"))).otherwise(F.struct(p["l"].alias("l"), right(p, i).alias("r")))
    rounds = range(s.rounds)[::-1] if back else range(s.rounds)
    first = F.struct(F.floor(x / F.lit(b).cast("decimal(20,0)")).cast("long").alias("l"), mod(x, b).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), first, step, lambda p: p["l"] * F.lit(b).cast("long") + p["r"])


def _walked(x: Column, n: int, s: Settings, back: bool) -> Column:
    a, b = sides(n)
    once = _network(x.cast("long"), n, s, back)
    outside = a * b - n
    if not outside:
        return once
    limit = F.lit(n).cast("long")
    on = lambda y: F.aggregate(F.sequence(F.lit(1), F.lit(outside)), y, lambda v, _: F.when(v < limit, v).otherwise(_network(v, n, s, back)))
    # A lambda's argument is computed once, however often it is named.
    return F.transform(F.array(once), lambda y: F.when(y < limit, y).otherwise(on(y)))[0]


def permuted(number: Column, n: int, s: Settings = Settings()) -> Column:
    """The place of a row number, both from 0 to n-1."""
    return _walked(number, n, s, False)


def restored(place: Column, n: int, s: Settings = Settings()) -> Column:
    """The row number of a place."""
    return _walked(place, n, s, True)


def place(rows: DataFrame, by: list[str], s: Settings = Settings()) -> DataFrame:
    """row (a struct of all columns), number, shard, slot of each row. Rows equal in `by` are ordered by a hash of all columns."""
    scratch = Scratch(rows.sparkSession, "shards")
    whole = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    grouped = scratch.keep(whole.groupBy("row").agg(F.count("*").alias("copies")), "grouped")
    n = grouped.agg(F.sum("copies")).first()[0] or 0
    text = lambda c: F.coalesce(F.col("row")[c].cast("string"), F.lit(""))
    keyed = grouped.withColumn("hash", hashed(*[text(c) for c in by]))
    part = F.floor(F.col("hash") / F.lit(2**60 // s.parts)).cast("int")
    first = firsts(keyed, part, [F.col("hash"), *[F.col("row")[c] for c in by], F.xxhash64("row")], "copies", "first")
    each = copies(scratch.keep(first.select("row", "copies", "first"), "first"), "copies", "i", s.chunk)
    scratch.drop("grouped")
    number = F.col("first") + F.col("i")
    at = each.select("row", number.alias("number"), permuted(number, n, s).alias("_at"))
    shards = F.lit(s.shards).cast("long")
    return at.select("row", "number", F.pmod("_at", shards).cast("int").alias("shard"), ((F.col("_at") - F.pmod("_at", shards)) / shards).cast("long").alias("slot"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32: UTF-8 bytes of the text plus 8, and their checksum."""
    return docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))


def assigned(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document. Only these small columns are shuffled, never a text."""
    placed = place(sized(docs), ["doc_id", "size", "text_crc32"], s)
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, by: list[str], path: str, s: Settings = Settings()) -> None:
    """Writes all rows to folders `shard=0` and so on, each file in the order of `slot`; the columns lie in `row`. The texts are shuffled twice, to
    be counted and to their shards; a shard is written by as many tasks as it has rows to fill."""
    placed = place(docs, by, s)
    stripe = F.floor(F.col("slot") / s.chunk)
    placed.repartition("shard", stripe).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
