"""Target-distribution importance resampling: documents drawn without replacement by how much more likely their words are in a target.

Features are runs of 1 to `max_n` words, hashed to `buckets` by their CRC-32. A worker classifies the bytes of an Arrow text column with a
lookup table, finds words where the class changes, and advances a table-driven CRC one byte at a time for all words at once; a run's
checksum goes on from that of the run one word shorter. Two passes over the texts: the first counts buckets, once a task; the
second sums up the buckets' gains, `buckets` numbers that travel with it. A keyed Gumbel noise makes the highest scores a draw.
Only (id, counts, score) are shuffled and ranked, in ranges of the score between approximate quantiles.

Nulls: a null text has no features, a null id is hashed as an empty one and ties behind all others. Empty and wordless texts: weight 0. Short
texts (under `least_words`) are never drawn. Ties: the smaller id, then fewer features. Repeated rows: each counts, and is ranked, for
itself. Long texts and words: whole; once few words are left in step, zlib goes on with them. An empty table: no rows. An empty target: all t are 0.
Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_rows, copies, firsts, text_sizes


@dataclass(frozen=True)
class Settings:
    max_n: int = 3
    buckets: int = 10_000
    scale: int = 1000
    percent: int = 5
    least_words: int = 20
    seed: int = 42
    #: Ranges of the score that are ranked each by itself.
    ranges: int = 256
    #: Bytes of text that a worker holds in arrays at a time, but for a longer text.
    slice_bytes: int = 1 << 20
    chunk: int = 65536


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: itself with A-Z lower-cased, whether it belongs to a word, and the CRC-32's step (reflected polynomial)."""
    byte = np.arange(256, dtype=np.uint8)
    lower = np.where((byte >= ord("A")) & (byte <= ord("Z")), byte + 32, byte).astype(np.uint8)
    word = ((byte >= ord("0")) & (byte <= ord("9"))) | ((byte >= ord("a")) & (byte <= ord("z"))) | (byte >= 0x80)
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return lower, word, crc


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its rows' offsets in them, without a copy; a null has none."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.empty(0, np.uint8)
    return own, at - at[0]


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, row) of each word of lower-cased bytes; a row's end ends its last word."""
    inside = tables()[1][data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    for flag, at in ((begins, offsets[:-1][filled]), (ends, offsets[1:][filled] - 1)):
        flag[at] = inside[at]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def advance(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray, few: int = 8) -> np.ndarray:
    """CRC states after `length` more bytes from `start`, a byte of all runs a step; when `few` are left, each goes on by itself."""
    crc = tables()[2]
    order = np.argsort(-np.minimum(length, 0x7FFF).astype(np.int16), kind="stable")
    at, of, left = start[order], state[order], length[order]
    # Runs above the sort key's range come first in any order: they are told apart by their true lengths below.
    long = int(np.count_nonzero(length > 0x7FFE))
    steps = np.bincount(np.minimum(length, 0x7FFF), minlength=1)
    more = len(length) - np.cumsum(steps)  # more[t]: runs longer than t
    t, n = 0, int(more[0]) if len(length) else 0
    while n > max(few, long):
        of[:n] = crc[(of[:n] ^ data[at[:n] + t]) & 0xFF] ^ (of[:n] >> 8)
        t += 1
        n = int(more[t])
    for i in range(n):
        rest = data[at[i] + t : at[i] + left[i]].tobytes()
        of[i] = zlib.crc32(rest, int(of[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = of
    return out


def features(column: pa.Array, s: Settings) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each row's number of words; and for 1, 2, ... words the runs' (rows, buckets)."""
    raw, offsets = bytes_of(column)
    lower, _, crc = tables()
    data = lower[raw]
    start, length, row = bounds(data, offsets)
    out, last = [], np.arange(len(start))  # a run is known by its last word
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for n in range(s.max_n):
        if n:  # a run of one word more goes on over a space
            on = last[: np.searchsorted(last, len(start) - 1)]
            goes = row[on + 1] == row[on]
            last, state = on[goes] + 1, state[: len(on)][goes]
            state = crc[(state ^ 0x20) & 0xFF] ^ (state >> 8)
        state = advance(state, data, start[last], length[last])
        out.append((row[last], (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(s.buckets)))
    return np.bincount(row, minlength=len(column)), out


COUNTS = "bucket int, n long"
WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def _slices(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    return by_rows(batches, text_sizes(), s.slice_bytes)


def _counted(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """A task's features by bucket, in one batch at its end."""
    n = np.zeros(s.buckets, np.int64)
    for b in _slices(batches, s):
        for _, bucket in features(b.column("text"), s)[1]:
            n += np.bincount(bucket, minlength=s.buckets)
    some = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["bucket", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], gains: np.ndarray, s: Settings) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, s):
        words, runs = features(b.column("text"), s)
        n, weight = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
        for row, bucket in runs:
            n += np.bincount(row, minlength=b.num_rows)
            weight += np.bincount(row, gains[bucket], b.num_rows).astype(np.int64)  # whole numbers below 2^53: exact
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])


def bucket_counts(texts: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Features of all texts by bucket: `buckets` numbers, whatever the table's size."""
    out = np.zeros(s.buckets, np.int64)
    for r in texts.select("text").mapInArrow(lambda it: _counted(it, s), COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray, s: Settings = Settings()) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: the log ratio of its smoothed shares, in whole thousandths."""
    ours, theirs = source.astype(np.float64), target.astype(np.float64)
    return np.floor(s.scale * np.log((theirs + 1) * (ours.sum() + s.buckets) / ((ours + 1) * (theirs.sum() + s.buckets))))


def scored(docs: DataFrame, gains: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each document."""
    rows = docs.select("doc_id", "text").mapInArrow(lambda it: _weighed(it, gains, s), WEIGHTS)
    seed = F.concat(F.lit(f"{s.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-F.lit(float(s.scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return rows.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`rank` of the highest scores, `percent` of the rows of enough words, from 1; null for all others. `rows` must be cheap to read again."""
    enough = F.col("n_words") >= s.least_words
    groups = rows.where(enough).groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    points = [i / s.ranges for i in range(1, s.ranges)]
    many, cuts = rows.where(enough).agg(F.count("*"), F.percentile_approx("score", points, 10_000)).first()
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [])))).cast("array<long>"), lambda x: x > F.col("score")))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    placed = copies(firsts(groups, part, order, "_n", "_first"), "_n", "_i", s.chunk)
    rank = F.col("_first") + F.col("_i") + 1
    own = placed.select(*rows.columns, F.when(rank <= s.percent * many // 100, rank).cast("long").alias("rank"))
    return own.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each document; `target` holds the texts to come near to."""
    gains = gains_of(bucket_counts(docs, s), bucket_counts(target, s), s)
    return ranked(Scratch(docs.sparkSession, "resample").keep(scored(docs, gains, s), "scored"), s)


def drawn(docs: DataFrame, target: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The drawn documents with all their columns. Rows of equal id come together once one of them is drawn; rows without an id don't."""
    ids = resample(docs, target, s).where("rank is not null and doc_id is not null").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(docs.columns)
