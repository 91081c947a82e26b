"""Packing: documents cut to pieces and put into sequences of equal length, as a cutting-stock problem.

A document's ids, with an end id, are cut into full sequences and a rest. Lengths are counted in units of
`Settings.unit` tokens, rounded up, so the histogram has at most `size / unit` classes however large the corpus
is; it alone reaches the driver. There column generation solves the linear program over patterns (how many
pieces of each class one sequence takes): the simplex method gives each class a price, and a knapsack dynamic
program finds the pattern worth most. What the sequences cost over the dearest pattern's worth is a lower bound of any solution's cost; it
ends when the solution is within `Settings.gap` of the best bound seen. After `Settings.rounds` patterns it ends as well, with a
warning that gives the gap reached: every piece still has its place then, only padding is more.
The patterns' counts are rounded down; what that leaves, less than a sequence for each class, is filled by
subset sums from the largest piece on. Every piece gets its rank among those of its class (`common.numbered`, which
deals hot classes over many tasks), and its class and rank name its sequence.

Defined cases: a null or empty text is a document of the end id alone; equal rows are packed one by one; a null id stays
null; extra columns are ignored; an empty table gives an empty table. A sequence is padded to the
full size unless its length is a power of two.
"""

from __future__ import annotations

import functools
import json
import warnings
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_rows, numbered, text_sizes, texts_of

#: Fixed value: how byte-level BPE files of this family split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Settings:
    tokenizer: str | None = None  # default_tokenizer()
    end_id: int = 1
    size: int = 2048
    unit: int = 8
    gap: float = 5e-4
    rounds: int = 4000


def _bytes_of_signs() -> dict[str, int]:
    """Byte-level files write a byte that can't be printed as the next free sign from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """The ids of a text without special tokens, as the tokenizers library gives them for this file.

    A byte-level BPE whose merges are numbered in order is run by tiktoken, which gives the same ids in a
    quarter of the time; any other file by tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and not spec.get("normalizer")
    vocab = {k: v for k, v in model["vocab"].items() if k not in added} if plain else {}
    signs = _bytes_of_signs()
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])] if plain else []
    if plain and [vocab.get(m.replace(" ", "")) for m in merges] == list(range(256, 256 + len(merges))) and all(c in signs for k in vocab for c in k):
        import tiktoken

        ranks = {bytes(signs[c] for c in k): v for k, v in vocab.items()}
        own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)
        names = set(added)
        return lambda text: own.encode_to_numpy(text, allowed_special=names, disallowed_special=())
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(path)
    return lambda text: np.array(other.encode(text, add_special_tokens=False).ids, np.uint32)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    encode = encoder(s.tokenizer or default_tokenizer())
    for b in by_rows(batches, text_sizes(), 1 << 20):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts_of(b), strict=True):
            ids = np.append(encode(text).astype("<u4"), np.array([s.end_id], "<u4"))
            for a in range(0, len(ids), s.size):
                part = ids[a : a + s.size]
                rows.append((doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
        names = [x.split()[0] for x in PIECES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def pieces(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The pieces of each document: full sequences, then the rest."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _pieces(it, s), PIECES)


# The linear program ---------------------------------------------------------------------------------------------------


def best_pattern(prices: np.ndarray, widths: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The knapsack: the counts of widths within `size` whose prices sum up highest, by dynamic programming."""
    good = np.flatnonzero(prices > 0)
    w, p = widths[good], prices[good]
    worth, taken = np.zeros(size + 1), np.full(size + 1, -1)
    for at in range(1, size + 1):
        worth[at] = worth[at - 1]
        k = np.searchsorted(w, at, "right")
        if k:
            tried = worth[at - w[:k]] + p[:k]
            if tried[i := int(tried.argmax())] > worth[at] + 1e-12:
                worth[at], taken[at] = tried[i], i
    counts, at = np.zeros(len(widths), np.int64), size
    while at > 0:
        if taken[at] < 0:
            at -= 1
        else:
            counts[good[taken[at]]] += 1
            at -= int(w[taken[at]])
    return float(worth[size]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by elimination, without the thread pool of a linear algebra library in the driver."""
    n = len(a)
    x = np.hstack([a.astype(float), np.eye(n)])
    for i in range(n):
        k = i + int(np.abs(x[i:, i]).argmax())
        x[[i, k]] = x[[k, i]]
        x[i] /= x[i, i]
        way = x[:, i].copy()
        way[i] = 0
        x -= np.outer(way, x[i])
    return x[:, n:]


def patterns(widths: np.ndarray, demand: np.ndarray, size: int, gap: float, rounds: int, hold: float = 0.9) -> list[tuple[float, np.ndarray]]:
    """(uses, counts by width) of a basic solution of the linear program, by column generation.

    widths rise and none exceeds size. The solution has at most `gap` more sequences than the best one, as a part of them, unless `rounds` end before.
    """
    base = np.diag(size // widths)
    inverse = np.diag(1.0 / np.diag(base))
    uses = (inverse * demand).sum(1)
    bound, best, pivots = 0.0, None, 0
    for k in range(rounds + 1):
        prices = inverse.sum(0)
        # Prices swing from round to round; those that gave the best bound hold them back, which takes a quarter of the rounds.
        tried = prices if best is None else hold * best + (1 - hold) * prices
        worth, column = best_pattern(tried, widths, size)
        for again in (True, False):
            # A pattern's worth scales the prices down to ones that no pattern exceeds: what the demand then costs bounds every solution.
            if (below := float(demand @ tried) / max(worth, 1e-12)) > bound:
                bound, best = below, tried / worth
            if again and prices @ column <= 1 + 1e-9 and uses.sum() > (1 + gap) * bound:
                tried = prices  # the held prices found nothing for the solution at hand
                worth, column = best_pattern(tried, widths, size)
            else:
                break
        if uses.sum() <= (1 + gap) * bound or prices @ column <= 1 + 1e-9:
            break
        if k == rounds:
            warnings.warn(f"column generation ended after {rounds} rounds, {uses.sum() / bound - 1:.2%} above the lower bound", stacklevel=2)
            break
        way = (inverse * column).sum(1)
        ratio = np.where(way > 1e-9, uses / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        uses = np.maximum(uses - ratio[out] * way, 0)
        uses[out] = ratio[out]
        row = inverse[out] / way[out]
        inverse -= np.outer(way, row)
        inverse[out] = row
        base[:, out] = column
        pivots += 1
        if pivots % 400 == 0:  # rounding errors don't add up
            inverse = inverted(base)
            uses = np.maximum((inverse * demand).sum(1), 0)
    return [(float(x), base[:, i].copy()) for i, x in enumerate(uses)]


def fill(widths: np.ndarray, left: np.ndarray, size: int) -> list[np.ndarray]:
    """Patterns for the pieces that are left, each the largest piece and a subset of the others that fills best."""
    left, out = left.copy(), []
    while left.any():
        counts = np.zeros(len(widths), np.int64)
        top = int(np.flatnonzero(left)[-1])
        counts[top] += 1
        left[top] -= 1
        room = size - int(widths[top])
        steps, sums, full = [], 1, (1 << room + 1) - 1
        for i in np.flatnonzero(left)[::-1]:
            w, n, k = int(widths[i]), int(left[i]), 1
            if w > room:
                continue
            n = min(n, room // w)
            while n:
                k = min(k, n)
                steps.append((i, k, sums))
                sums |= sums << k * w & full
                n, k = n - k, 2 * k
            if sums >> room & 1:
                break
        at = sums.bit_length() - 1
        for i, k, before in reversed(steps):
            if not before >> at & 1:
                counts[i] += k
                left[i] -= k
                at -= k * int(widths[i])
        out.append(counts)
    return out


@dataclass
class Plan:
    """For each class, from which rank on which pattern holds: its first sequence and its pieces of the class."""

    first_rank: dict[int, np.ndarray]
    first_sequence: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    sequences: int

    def place(self, cls: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty(len(cls), np.int64)
        for c in np.unique(cls):
            own = cls == c
            i = np.searchsorted(self.first_rank[c], rank[own], "right") - 1
            out[own] = self.first_sequence[c][i] + (rank[own] - self.first_rank[c][i]) // self.each[c][i]
        return out


def plan(histogram: dict[int, int], s: Settings = Settings()) -> Plan:
    """Sequences for a histogram of pieces by class (length in units, rounded up)."""
    size = s.size // s.unit
    widths = np.array(sorted(c for c in histogram if c < size), np.int64)
    demand = np.array([histogram[c] for c in widths], np.int64)
    found: list[tuple[int, dict[int, int]]] = [(histogram[size], {size: 1})] if histogram.get(size) else []
    if len(widths):
        left = demand.copy()
        solved = patterns(widths, demand.astype(float), size, s.gap, s.rounds)
        for uses, counts in sorted(solved, key=lambda x: -x[0]):
            own = np.flatnonzero(counts)
            if n := int(min(np.floor(uses + 1e-6), (left[own] // counts[own]).min())):
                left -= n * counts
                found.append((n, {int(widths[i]): int(counts[i]) for i in own}))
        found += [(1, {int(widths[i]): int(c[i]) for i in np.flatnonzero(c)}) for c in fill(widths, left, size)]
    at, rows = 0, {}
    for n, counts in found:
        for c, k in counts.items():
            before = rows.setdefault(c, [[0], [], []])
            before[1].append(at)
            before[2].append(k)
            before[0].append(before[0][-1] + n * k)
        at += n
    return Plan(
        {c: np.array(x[0][:-1]) for c, x in rows.items()}, {c: np.array(x[1]) for c, x in rows.items()}, {c: np.array(x[2]) for c, x in rows.items()}, at
    )


def _place(batches: Iterator[pa.RecordBatch], p: Plan) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = p.place(b.column("_class").to_numpy(), b.column("_rank").to_numpy())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], names=[*b.schema.names, "sequence_id"])


def pack(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    made = Scratch(docs.sparkSession, "packing").keep(pieces(docs, s), "pieces")
    cut = made.withColumn("_class", F.ceil(F.col("length") / s.unit).cast("int"))
    histogram = {r[0]: r[1] for r in cut.groupBy("_class").count().collect()}
    shared = docs.sparkSession.sparkContext.broadcast(plan(histogram, s))
    order = F.xxhash64("doc_id", "start", "ids_crc32")
    ranked = numbered(cut, ["_class"], order, [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "_rank")
    ranked = ranked.select(*[x.split()[0] for x in PIECES.split(", ")], "_class", F.col("_rank").cast("long"))
    placed = ranked.mapInArrow(lambda it: _place(it, shared.value), f"{PIECES}, _class int, _rank long, sequence_id long")
    ahead = Window.partitionBy("sequence_id").orderBy("_class", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("_class", "_rank")
