"""Document fingerprints: content-defined chunks and their length-weighted digest sets.

A gear hash of the last 16 bytes is known at every byte; a chunk ends where it has enough leading zero bits.
Chunking is normalised: a chunk has at least `least` bytes, up to `normal` bytes an end needs four bits more than
after it, and `most` bytes end it anyway. As no chunk but a text's last is shorter than the hash's window, boundaries depend on the
text alone and find themselves again after an edit. Chunks have 16 to 48 bytes, so that a text of 200 characters has several and keeps one
where its first quarter stays (where only its last half stays, boundaries meet again within 100 bytes in about half of such texts); a fingerprint then is about half as long as its text (larger `Settings` give shorter ones). A fingerprint is the text's set of chunk digests
(64 bits) with their lengths; the containment of one in another is the share of its length that both hold.

`fingerprints` also compares each document with the next one in descending order of ids. One job gathers range bounds of
the ids; then each row goes to its range once, and the first row of each range also to the range before, so
that every task has the successor of its last row. Nothing else is moved, and tasks read their rows in order.

Defined cases: a null or empty text has an empty fingerprint, which an empty fingerprint contains (1.0) and any other
doesn't (0.0); rows of equal ids follow each other by text; null ids come last and stay null; a
table of one row has that row as its next; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_rows, text_sizes, texts_of
from .neardup import mix, powers

LOW = -(1 << 63)


@dataclass(frozen=True)
class Settings:
    least: int = 16  # the hash's window at least
    normal: int = 32
    most: int = 48
    seed: int = 7


def _gear(seed: int) -> np.ndarray:
    return (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed * 2 + 1)) >> np.uint64(32)).astype(np.uint32)


def rolling(b: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of the table's values of the last 16 bytes, each doubled once for each later byte."""
    h = gear[b]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cut(texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every chunk within the joined texts, and the index of the first chunk of each text, with the total at the end."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    h = rolling(b, _gear(s.seed)) if len(b) else np.zeros(0, np.uint32)
    bits = s.normal.bit_length() - 1
    loose = np.flatnonzero(h < np.uint32(1 << 32 - bits + 2))
    strict = loose[h[loose] < np.uint32(1 << 32 - bits - 2)].tolist()
    loose = loose.tolist()
    starts, ends, first, at = [], [], [], 0
    for t in texts:
        first.append(len(starts))
        end = at + len(t)
        while at < end:
            stop = min(at + s.most, end)
            i = bisect_left(strict, at + s.least - 1)
            if i < len(strict) and strict[i] < min(at + s.normal, end):
                stop = strict[i] + 1
            else:
                i = bisect_left(loose, at + s.normal - 1)
                if i < len(loose) and loose[i] < stop:
                    stop = loose[i] + 1
            starts.append(at)
            ends.append(stop)
            at = stop
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array([*first, len(starts)])


Print = tuple[np.ndarray, np.ndarray]  # digests, rising, and their chunks' lengths


def prints(texts: list[bytes], s: Settings = Settings()) -> list[Print]:
    """The fingerprint of each text."""
    starts, ends, first = cut(texts, s)
    b = np.frombuffer(b"".join(texts), np.uint8)
    up, down = powers(len(b) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * up[: len(b)])])
    size = ends - starts
    digest = mix((total[ends] - total[starts]) * down[starts] ^ size.astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        own, at = np.unique(digest[a:z], return_index=True)
        out.append((own, size[a:z][at]))
    return out


def written(p: Print) -> str:
    """20 hexadecimal digits for each chunk: digest and length."""
    rows = np.empty(len(p[0]), np.dtype([("digest", ">u8"), ("size", ">u2")]))
    rows["digest"], rows["size"] = p
    return rows.tobytes().hex()


def containment(p: Print, q: Print) -> float:
    """The share of p's length whose chunks q has too."""
    if not len(p[0]):
        return float(not len(q[0]))
    at = np.searchsorted(q[0], p[0])
    both = np.zeros(len(p[0]), bool) if not len(q[0]) else q[0][np.minimum(at, len(q[0]) - 1)] == p[0]
    return float(p[1][both].sum() / p[1].sum())


def edited(text: str, other: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _deal(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, heads: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows with their range; a range's first rows again for the range before, as `ghost`."""
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    for b in batches:
        key = b.column("key").to_numpy()
        part = len(bounds) - np.searchsorted(bounds, key, "left")
        again = np.flatnonzero(np.isin(key, np.array(list(before), np.int64)))
        take = np.concatenate([np.arange(len(key)), again])
        to = np.concatenate([part, [before[int(k)] for k in key[again]]]).astype(np.int32)
        columns = b.take(pa.array(take))
        yield pa.RecordBatch.from_arrays([*columns.columns, pa.array(to), pa.array(np.arange(len(take)) >= len(key))], names=[*b.schema.names, "part", "ghost"])


def _compared(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Each row that isn't a ghost, against its follower; the rows come in order, ghosts last."""
    held: list[tuple[int | None, str, bool]] = []
    ghost_seen = False
    for b in by_rows(batches, text_sizes(), 1 << 20):
        rows = list(zip(b.column("doc_id").to_pylist(), texts_of(b), b.column("ghost").to_pylist(), strict=True))
        for r in rows:
            if not (r[2] and ghost_seen):  # of a range's first rows of equal ids only the first one follows
                held.append(r)
                ghost_seen |= r[2]
        if len(held) > 1:
            yield _rows(held, s)
            held = held[-1:]


def _rows(rows: list[tuple[int | None, str, bool]], s: Settings) -> pa.RecordBatch:
    texts = [t for _, t, _ in rows]
    other = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
    raw = [t.encode() for t in (*texts, *other)]
    made = prints(raw, s)
    own, new = made[: len(texts)], made[len(texts) :]
    out = [
        (rows[i][0], len(texts[i]), hashlib.sha256(raw[len(texts) + i]).hexdigest(), written(own[i]), written(new[i]), containment(own[i], new[i]), containment(own[i], own[i + 1]))
        for i in range(len(other))
    ]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    names, types = zip(*[x.split() for x in ROWS.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))


def fingerprints(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("key"))
    ids = keyed.select(F.col("key").cast("double").alias("x"))
    found = ids.approxQuantile("x", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    bounds = np.unique(np.array([int(max(x, LOW)) if x < 2.0**63 else 2**63 - 1 for x in found], np.int64))
    # One row for each range: where it begins, counted from the highest ids.
    ranges = keyed.select("key").mapInArrow(lambda it: _ranges(it, bounds), "part int, head long")
    heads = [(r[0], r[1]) for r in ranges.groupBy("part").agg(F.max("head")).orderBy("part").collect()]
    dealt = keyed.mapInArrow(lambda it: _deal(it, bounds, heads), "doc_id long, text string, key long, part int, ghost boolean")
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions(F.col("ghost"), F.col("key").desc(), F.col("text"))
    return ordered.select("doc_id", "text", "ghost").mapInArrow(lambda it: _compared(it, s), ROWS)


def _ranges(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    most: dict[int, int] = {}
    for b in batches:
        key = b.column("key").to_numpy()
        part = len(bounds) - np.searchsorted(bounds, key, "left")
        for p in np.unique(part):
            most[int(p)] = max(most.get(int(p), LOW), int(key[part == p].max()))
    yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array(list(most.values()), pa.int64())], names=["part", "head"])
