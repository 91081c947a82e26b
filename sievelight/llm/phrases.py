"""Phrase collocation mining: runs of words that occur together more often than their parts let expect, by language.

Texts are split into pieces, pieces into words, and all runs of 1 and 2 words become rows, which are counted by a hash aggregate per
language; counts are made in each task first, so that a frequent phrase is shuffled once a task. Then runs of 3 words are counted alike, of 4, and so on to
`max_n`: a phrase that occurs `least` times has a first and a last part of one word less that do, so only runs with both parts among those found become
rows. Tasks look the parts up in a table of bits, marked by a hash and broadcast, whose size `bits` bounds; where hashes clash a run is counted in vain, and
no phrase is lost. Words are so split once for 1 and 2 words and once more for each further length. Single words and phrases that
occur `least` times stay. Each cut of a phrase is joined to the counts of its two parts and scored in Decimal, whole numbers throughout: a * a
* scale is exact up to 10^16 occurrences, beyond which Spark's ANSI mode ends the query with an overflow. A phrase inside a longer one of
nearly its count goes: it is enough to look at phrases of one word more, as a still longer one implies such a one. Ranks: the best
`top` of each of `salts` parts of a language first, then the best of those, so no task ranks a language's phrases whole.

A join's hot key is a frequent word that many phrases begin with; the other side has one row for it, so Spark can split the key (AQE).

Nulls: a null text has no phrases, a null language is `und`, as is a language of that name. Empty texts, pieces and tables: no phrases. Ties: by count,
then by phrase in byte order. Repeated rows count again. Long texts: whole; a text's pieces are rows, so one piece bounds a row. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of pieces.
STOPS = r"[.,;:!?\x0A-\x0D]+"


@dataclass(frozen=True)
class Settings:
    max_n: int = 3
    #: Occurrences of a phrase.
    least: int = 10
    #: Percent of a phrase's occurrences that a longer one must have to stand for it.
    share: int = 50
    scale: int = 1_000_000
    top: int = 2000
    salts: int = 64
    #: The power of two of the bits that mark phrases, 12 at least; 27 are 17 MB for each executor.
    bits: int = 27


def windows(docs: DataFrame, n: int) -> DataFrame:
    """lang, w0, w1, ...: each word and those that follow it in its piece, `n` in all, null past the end; no lambda runs, so that all stays in generated code."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    pieces = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.explode(F.split(text, STOPS)).alias("piece"))
    words = pieces.select("lang", F.trim(F.col("piece"), F.lit(" \t")).alias("piece")).where("piece != ''").select("lang", F.split("piece", "[\\x20\\x09]+").alias("words"))
    beside = F.arrays_zip(*[F.slice("words", F.lit(i + 1), F.size("words")).alias(f"w{i}") for i in range(n)])
    return words.select("lang", F.inline(beside).alias(*[f"w{i}" for i in range(n)]))


def key(n: int) -> Column:
    """The phrase of the first `n` words, a tab and the language; words hold no tab."""
    return F.concat("w0", *[x for i in range(1, n) for x in (F.lit(" "), F.col(f"w{i}"))], F.lit("\t"), "lang")


def counted(keys: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, phrase, words (in it), f: all single words, and the phrases that occur `least` times."""
    n = F.length(F.col("phrase")) - F.length(F.replace(F.col("phrase"), F.lit(" "), F.lit(""))) + 1
    # One key is a shorter row than two; a count that outgrows a task's memory is sorted by its key's first bytes, in which languages don't differ.
    counts = keys.groupBy("key").agg(F.count("*").alias("f"))
    phrase = F.substring_index("key", "\t", 1)
    lang = F.substring(F.col("key"), F.length(phrase) + 2, F.length("key"))
    counts = counts.select(lang.alias("lang"), phrase.alias("phrase"), "f")
    return counts.select("lang", "phrase", n.cast("int").alias("words"), "f").where((F.col("words") == 1) | (F.col("f") >= s.least))


def slot(words: list[Column], s: Settings) -> Column:
    """The bit of a phrase, by a hash of its language and words."""
    return F.shiftrightunsigned(F.xxhash64("lang", *words), 64 - s.bits)


def marks(found: DataFrame, n: int, s: Settings = Settings()) -> DataFrame:
    """block, marked: the bits of the phrases of `n` words, 64 longs a row, so at most 2 to the power of `bits` of them whatever the data."""
    each = found.where(F.col("words") == n).withColumn("w", F.split("phrase", " ")).select(slot([F.get("w", F.lit(i)) for i in range(n)], s).alias("bit"))
    longs = each.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("x"))
    blocks = longs.groupBy(F.shiftright("at", 6).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("CAST(at & 63 AS INT)"), "x"))).alias("x"))
    return blocks.select("block", F.expr("transform(sequence(0, 63), i -> coalesce(x[i], 0L))").alias("marked"))


def longer(docs: DataFrame, found: DataFrame, n: int, s: Settings = Settings()) -> DataFrame:
    """key of each run of `n` words whose first and last n - 1 words may be among `found`: all whose parts are, and few others while the marked bits are few."""
    at, marked = windows(docs, n).where(F.col(f"w{n - 1}").isNotNull()), F.broadcast(marks(found, n - 1, s))
    for first in (0, 1):
        at = at.withColumn("bit", slot([F.col(f"w{i}") for i in range(first, first + n - 1)], s))
        has = F.expr("getbit(get(marked, CAST(shiftright(bit, 6) & 63 AS INT)), CAST(bit & 63 AS INT)) = 1")
        at = at.join(marked, (F.shiftright("bit", 12) == F.col("block")) & has, "left_semi").drop("bit")
    return at.select(key(n).alias("key"))


def counts(docs: DataFrame, scratch: Scratch, s: Settings = Settings()) -> DataFrame:
    """lang, phrase, words (in it), f: all single words, and the phrases that occur `least` times."""
    m = min(s.max_n, 2)
    short = windows(docs, m).select(F.explode(F.array(*[key(n + 1) for n in range(m)])).alias("key")).where("key is not null")
    found = scratch.keep(counted(short, s), "counts")
    for n in range(3, s.max_n + 1):
        found = found.unionByName(scratch.keep(counted(longer(docs, found, n, s), s), f"counts{n}"))
    return found


def scored(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, phrase, words, a, l, r, score of each candidate, by its lowest cut."""
    cut = F.col("cut")
    each = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    each = each.select("lang", "phrase", "words", "a", "cut", F.array_join(F.slice("w", F.lit(1), cut), " ").alias("first"), F.array_join(F.slice("w", cut + 1, F.col("words") - cut), " ").alias("rest"))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    each = each.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # Precision is stated step by step, as Spark would else round a product that might not fit.
    score = F.expr(f"CAST(CAST(CAST(a AS DECIMAL(17,0)) * CAST(a AS DECIMAL(17,0)) AS DECIMAL(32,0)) * {s.scale} AS DECIMAL(38,0)) div CAST(CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)) AS DECIMAL(37,0))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")
    return each.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "x.l", "x.r", F.col("x.score").cast("long").alias("score"))


def within(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, phrase of those that a phrase of one word more stands for."""
    w = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice(w, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(w, F.lit(2), F.col("words") - 1), " "))
    longer = found.where("words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("_longer"))
    return found.where("words > 1").join(longer, ["lang", "phrase"]).where(100 * F.col("_longer") >= s.share * F.col("f")).select("lang", "phrase")


def top(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The first `top` rows of each language with their rank."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(s.salts)))
    few = salted.withColumn("_in", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_in") <= s.top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= s.top).drop("_salt", "_in")


def collocations(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language."""
    scratch = Scratch(docs.sparkSession, "phrases")
    found = counts(docs.select("text", "lang"), scratch, s)
    n = found.where("words = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    rows = scored(found, s).join(within(found, s), ["lang", "phrase"], "left_anti")
    return top(rows, s).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
