"""Near-duplicates: SuperMinHash signatures, banding, verification on full sets, and union-find grouping.

1. A document's set is its distinct shingles of `Settings.words` lower-cased words, as 64-bit hashes. Equal sets
   form a class (by a 128-bit digest); its id is its smallest document id, and only classes go on.
2. SuperMinHash: step j gives each element one slot of a random permutation of its own and a value j + u. A
   slot keeps its least value. As step j can't beat values below j, a set ends as soon as all its slots are
   below the step; large sets need two or three steps for all slots.
3. `bands` bands of `rows` slots each give buckets. At a similarity of 0.85 a pair misses all 24 bands of
   5 slots with a probability below 1e-6.
4. In a bucket, signatures (8 bits a slot) estimate similarities. A bucket of more than `block` classes is first cut
   by set size (links differ by a bounded ratio, and a class goes to its own size and the next lower one). A first round verifies a spanning forest of the
   most alike, each row of a larger bucket meeting one random block of it, another one in each band: so a group of copies grows together
   in work that is linear in it. In a second round, buckets in which several components are left meet again: rows outside of the
   bucket's largest component meet all of it, block by block, and one another; the largest component's rows don't meet among themselves. The rows that
   may have links out of their component bring their full sets, and the links that join components leave. No bucket is capped.
5. Where rows outside of the largest component fill more than `bands` blocks, most of the bucket is not alike, and blocks would be quadratic in it. The rows
   of all such buckets meet by their rarest members instead (`by_rare_members`), which loses no link: sets that differ in at most 15 % of
   their members share one of the 15 % and one that are rarest in each. Pages of one template share their template's members, which are
   the most frequent ones and so bring no two of them together. The groups of one member then meet as buckets do.
6. Links are confirmed on full sets, in integers: 100 * intersection >= percent * union.
7. Components: union-find within each partition shrinks the links to forests, then rounds of
   large-star and small-star steps join them until nothing changes; each round is a written table.

Defined cases: null or empty texts and texts of white space have an empty set and are linked with nothing; rows of
equal ids count as one document; equal rows stay equal rows; a null id takes the component of an equal set
with an id, else null, and is kept then. Extra columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_rows, text_sizes, texts_of

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_GOLD, _P, _Q = np.uint64(0x9E3779B97F4A7C15), 0x5851F42D4C957F2D, np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5
    alike: int = 86  # slots of bands * rows that must agree for the first round
    doubtful: int = 78  # and for the second
    block: int = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.array([1] + [b] * (size - 1), np.uint64)) for b in (_P, pow(_P, -1, 1 << 64))]
    return _powers[0], _powers[1]


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [t.encode().translate(_LOWER) + b" " for t in texts]
    b = np.frombuffer(b" " + b"".join(raw), np.uint8)
    up, down = powers(len(b))
    space = _SPACE[b]
    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * up[: len(b)])])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)
    first = np.searchsorted(start, np.cumsum([1] + [len(x) for x in raw]))
    run = np.zeros(max(len(word) - k + 1, 0), np.uint64)
    for i in range(k):
        run = run * _Q + word[i : i + len(run)]
    run = mix(run)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= k:
            out.append(np.unique(run[a : z - k + 1]))
        elif z > a:
            h = np.array([z - a], np.uint64)
            for i in range(a, z):
                h = h * _Q + word[i : i + 1]
            out.append(mix(h ^ _GOLD))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A signature of m slots for each set, none of them empty; a value is step * 2**32 + 32 random bits."""
    count = np.array([len(x) for x in sets])
    element, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), count)
    sign = np.full((len(sets), m), np.iinfo(np.uint64).max, np.uint64)
    flat, order = sign.reshape(-1), None
    low = np.uint64(0xFFFFFFFF)
    for j in range(m):
        x = mix(element + np.uint64((j + 1) * int(_GOLD) & (1 << 64) - 1))
        pick = (np.uint64(j) + ((x & low) * np.uint64(m - j) >> np.uint64(32))).astype(np.int64)
        if order is None:
            slot = pick
        else:
            own = np.arange(len(element))
            slot = order[own, pick].astype(np.int64)
            order[own, pick] = order[:, j]
        np.minimum.at(flat, doc * m + slot, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        going = sign.max(1) >= np.uint64(j + 1) << np.uint64(32)
        if not going.any():
            break
        keep = going[doc]
        if order is None:
            element, doc, pick = element[keep], doc[keep], pick[keep]
            order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(element), 1))
            order[np.arange(len(element)), pick] = 0
        elif keep.mean() < 0.6:
            element, doc, order = element[keep], doc[keep], order[keep]
    return sign


def buckets(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (len(sign), bands)).copy()
    for i in range(rows):
        key = mix(key * _Q + sign[:, i : bands * rows : rows])
    return key.view(np.int64)


BASE = "doc_id long, n_shingles long, digest binary, keys array<long>, sign binary"


def _signed(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    m = s.bands * s.rows
    for b in by_rows(batches, text_sizes(), 1 << 19):
        sets = shingle_sets(texts_of(b), s.words)
        own = [i for i, x in enumerate(sets) if len(x)]
        digest, keys, sign = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if own:
            made = superminhash([sets[i] for i in own], m)
            key, short = buckets(made, s.bands, s.rows), ((made * _Q) >> np.uint64(56)).astype(np.uint8)
            for k, i in enumerate(own):
                digest[i], keys[i], sign[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), key[k], short[k].tobytes()
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sign, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "keys", "sign"],
        )


def _sets(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for b in by_rows(batches, text_sizes(), 1 << 19):
        sets = shingle_sets(texts_of(b), s.words)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in sets], pa.binary())], names=["id", "members"])


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Each run of two rows or more that agree in the columns `names`, as one batch; the rows of a run follow each other."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held) > 1:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()

    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(n).to_numpy() for n in names], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(a, z - a)
            if held and any(held[0].column(n)[0] != part.column(n)[0] for n in names):
                yield from out()
            held.append(part)
    yield from out()


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """The other columns of each such run."""
    for b in _whole_groups(batches, names):
        yield [b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names if n not in names]


def agreeing(sign: np.ndarray, others: np.ndarray) -> np.ndarray:
    out = np.empty((len(sign), len(others)), np.int16)
    for i in range(0, len(sign), 32):
        out[i : i + 32] = (sign[i : i + 32, None, :] == others[None, :, :]).sum(2, dtype=np.int16)
    return out


def forest(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that agree in `least` slots, the most alike first (Prim)."""
    n, out = len(same), []
    best, near, inside = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
    for _ in range(n):
        i = int(np.where(inside, -2, best).argmax())
        if best[i] >= least:
            out.append((int(near[i]), i))
        inside[i] = True
        better = ~inside & (same[i] > best)
        best[better], near[better] = same[i][better], i
    return out


GROUP = ["key", "size", "one", "two"]


def _candidates(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Of each group the pairs of a spanning forest of the most alike: fewer than its rows."""
    for node, sign in _groups(batches, GROUP):
        own = np.frombuffer(b"".join(sign), np.uint8).reshape(len(node), -1)
        if pairs := forest(agreeing(own, own), s.alike):
            x, y = node[[i for i, _ in pairs]], node[[k for _, k in pairs]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])


def _open(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Of each group the rows that may have a link out of their component."""
    names = [*GROUP, "id", "comp"]
    for batch in _whole_groups(batches, GROUP):
        comp = batch.column("comp").to_numpy()
        own = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint8).reshape(len(comp), -1)
        same = agreeing(own, own)
        same[comp[:, None] == comp[None, :]] = -1
        yield batch.select(names).filter(pa.array((same >= s.doubtful).any(1)))


def _bits(sets: list[np.ndarray]) -> np.ndarray:
    """The sets as rows of bits over the members that two of them have at least; what one has alone is in no intersection."""
    size = np.array([len(x) for x in sets])
    _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(seen > 1) - 1
    own, row = seen[at] > 1, np.repeat(np.arange(len(sets)), size)
    width = -(-(int(rank[-1]) + 1) // 64) if len(rank) else 0
    bits = np.zeros((len(sets), max(width, 1)), np.uint64)
    place = rank[at[own]]
    np.bitwise_or.at(bits, (row[own], place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    return bits


def exact_links(sets: list[np.ndarray], comp: np.ndarray, percent: int, most: int = 1 << 20) -> list[tuple[int, int]]:
    """Links between the sets that join all components that any of their links joins; the sets hold sorted 64-bit hashes.

    Members are compared by ranges of their hashes, each of about `most` members, so that long texts take no more memory than short ones.
    """
    size = np.array([len(x) for x in sets])
    parts = -(-int(size.sum()) // most)
    edges = [k * (1 << 64) // parts for k in range(1, parts)]
    cuts = np.array([[0, *np.searchsorted(x, np.array(edges, np.uint64)), len(x)] for x in sets])
    fits = lambda i: (comp[i + 1 :] != comp[i]) & (100 * np.minimum(size[i], size[i + 1 :]) >= percent * np.maximum(size[i], size[i + 1 :]))
    comp, out, ahead = comp.copy(), [], None
    if edges:
        ahead = np.zeros((len(sets), len(sets)), np.int32)
        for k in range(len(edges) + 1):
            bits = _bits([x[c[k] : c[k + 1]] for x, c in zip(sets, cuts, strict=True)])
            for i in range(len(sets) - 1):
                near = i + 1 + np.flatnonzero(fits(i))
                ahead[i, near] += np.bitwise_count(bits[near] & bits[i]).sum(1, dtype=np.int32)
    else:
        bits = _bits(sets)
    for i in range(len(sets) - 1):
        near = i + 1 + np.flatnonzero(fits(i))
        if len(near):
            both = np.bitwise_count(bits[near] & bits[i]).sum(1, dtype=np.int64) if ahead is None else ahead[i, near].astype(np.int64)
            for k in near[100 * both >= percent * (size[i] + size[near] - both)]:
                if comp[k] != comp[i]:
                    out.append((i, int(k)))
                    comp[comp == comp[k]] = comp[i]
    return out


def _linked(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for node, comp, members in _groups(batches, GROUP):
        if pairs := exact_links([np.frombuffer(x, np.uint64) for x in members], comp, s.percent):
            x, y = node[[i for i, _ in pairs]], node[[k for _, k in pairs]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in by_rows(batches, lambda b: [len(x) + len(y) for x, y in zip(b.column("ours").to_pylist(), b.column("theirs").to_pylist(), strict=True)], 4 << 20):
        good = []
        for x, y in zip(b.column("ours").to_pylist(), b.column("theirs").to_pylist(), strict=True):
            n = (len(x) + len(y)) // 8
            union = len(np.union1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            good.append(100 * (n - union) >= percent * union)
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: each node with the least node of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y] if y in up else y
        return x

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in list(up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for i in range(0, len(pairs), 50_000):
        part = pairs[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in part], pa.int64()) for k in (0, 1)], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(a, b): each linked node that isn't its component's least, with that one."""
    now = scratch.keep(links.mapInArrow(_forests, "a long, b long").distinct(), f"{name}0")
    tell = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen, k = tell(now), 0
    while seen[0]:  # every round is a written table; it ends when nothing changes
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("c")).select("a", F.least("a", "c").alias("c"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("c").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("c"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("c").alias("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("x"))
        k += 1
        new = scratch.keep(small.select("x.a", "x.b").where("a != b").distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        after, now = tell(new), new
        if after == seen:
            break
        seen = after
    return now


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each member of each set, with the set's size."""
    for b in by_rows(batches, text_sizes("members"), 1 << 21):
        sets = b.column("members").to_pylist()
        size = np.array([len(x) // 8 for x in sets])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(b.column("id").to_numpy(), size)), pa.array(np.repeat(size, size).astype(np.int64)), pa.array(np.frombuffer(b"".join(sets), np.int64))],
            names=["id", "n_shingles", "member"],
        )


def size_number(n: Column, s: Settings) -> Column:
    """A link's sets differ in size by less than this logarithm's base, so their numbers by one at most."""
    return F.floor(F.log(n) / F.log(F.lit(100.0 / (s.percent - 0.1)))).cast("int")


def sizes_met(n_rows: Column, n_shingles: Column, s: Settings) -> Column:
    """The sizes under which a class stands in a bucket: -1 in a bucket of one block, else its own and the next lower one."""
    size = size_number(n_shingles, s)
    return F.when(n_rows <= s.block, F.array(F.lit(-1))).otherwise(F.array(size, size - 1))


def by_rare_members(sets: DataFrame, s: Settings) -> DataFrame:
    """(key, id, n_shingles): each set under its rarest members that another of the sets has too.

    Any two sets of (id, members) with 100 * intersection >= percent * union stand under one key together: in any order of all
    members, the first one that both have is within the first n - ceil(percent * n / 100) + 1 of each. The order is by frequency in `sets`, so
    that a key has few rows. Members that one set has alone take places in that order but are no keys. Rows grow with the sets' sizes alone.
    """
    each = sets.select("id", "members").mapInArrow(_exploded, "id long, n_shingles long, member long")
    often = each.groupBy("member").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("id")
    alone = F.col("n_shingles") - F.count("*").over(own)
    rank = F.row_number().over(own.orderBy("often", "member"))
    upto = F.expr(f"n_shingles - (n_shingles * {s.percent} + 99) div 100 + 1")
    placed = each.join(often, "member").withColumn("place", alone + rank)
    return placed.where(F.col("place") <= upto).select(F.col("member").alias("key"), "id", "n_shingles")


def mixed_buckets(marked: DataFrame, s: Settings, most: int | None) -> DataFrame:
    """Buckets (key, size) with several components: their largest one `top`, the numbers of blocks of it and of the others, and `wide`,
    whether the others fill more than `most` blocks."""
    each = marked.groupBy("key", "size", "comp").agg(F.count("*").alias("c"))
    stat = each.groupBy("key", "size").agg(F.sum("c").alias("n"), F.max(F.struct("c", (-F.col("comp")).alias("least"))).alias("x"), F.count("*").alias("comps")).where("comps > 1")
    whole = F.col("n") <= s.block
    inner = F.when(whole, 1).otherwise(F.ceil(F.col("x.c") / s.block)).cast("int")
    outer = F.when(whole, 1).otherwise(F.ceil((F.col("n") - F.col("x.c")) / s.block)).cast("int")
    return stat.select("key", "size", (-F.col("x.least")).alias("top"), inner.alias("inner"), outer.alias("outer"), (outer > most if most else F.lit(False)).alias("wide"))


def meetings(rows: DataFrame, s: Settings) -> DataFrame:
    """Each row in the groups in which it meets others: rows of the largest component are dealt to `inner` blocks, the others to `outer` ones;
    every block of others meets every block of the largest component and every block of others. A single block of others needs no group of its own."""
    block = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    rows = rows.withColumn("_in", block(F.col("inner"))).withColumn("_out", block(F.col("outer")))
    ours = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: F.struct(F.col("_in").alias("one"), j.cast("int").alias("two")))
    others = F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda i: F.struct(i.cast("int").alias("one"), F.col("_out").alias("two")))
    among = F.transform(F.sequence(F.lit(0), F.col("outer") - 1), lambda j: F.struct((F.col("inner") + F.least(j, F.col("_out"))).cast("int").alias("one"), F.greatest(j, F.col("_out")).cast("int").alias("two")))
    met = F.when(F.col("comp") == F.col("top"), ours).when(F.col("outer") == 1, others).otherwise(F.concat(others, among))
    return rows.select("key", "size", F.explode(met).alias("_met"), "id", "comp", "sign").select("key", "size", "_met.one", "_met.two", "id", "comp", "sign")


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    docs = docs.select("doc_id", "text")
    base = scratch.keep(docs.mapInArrow(lambda it: _signed(it, s), BASE), "base")
    first = [F.first(c).alias(c) for c in ("n_shingles", "keys", "sign")]
    classes = scratch.keep(base.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), *first), "classes")

    rows = classes.where("id is not null").select(F.explode("keys").alias("key"), "id")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(shared, "key").join(classes.select("id", "n_shingles", "sign"), "id")
    rows = scratch.keep(rows.select("key", F.explode(sizes_met(F.col("n"), F.col("n_shingles"), s)).alias("size"), "id", "sign"), "rows")
    count = rows.groupBy("key", "size").agg(F.count("*").alias("n")).where("n > 1")
    mine = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("n") / s.block)).cast("int")
    blocks = rows.join(count, ["key", "size"]).select("key", "size", mine.alias("one"), F.lit(0).alias("two"), "id", "sign")

    ids = blocks.select("id").distinct()
    texts = docs.join(ids.hint("shuffle_hash"), docs.doc_id == ids.id).select("id", "text").distinct()
    sets = scratch.keep(texts.mapInArrow(lambda it: _sets(it, s), "id long, members binary"), "sets")

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition(*GROUP).sortWithinPartitions(*GROUP)

    pairs = grouped(blocks).mapInArrow(lambda it: _candidates(it, s), "a long, b long").distinct()
    pairs = pairs.join(sets.withColumnsRenamed({"id": "a", "members": "ours"}), "a").join(sets.withColumnsRenamed({"id": "b", "members": "theirs"}), "b")
    sure = pairs.select("a", "b", "ours", "theirs").mapInArrow(lambda it: _confirm(it, s.percent), "a long, b long")
    found = components(sure, scratch, "one")

    known = found.select(F.col("a").alias("id"), F.col("b").alias("root"))
    marked = scratch.keep(rows.join(known, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"), "marked")
    scratch.drop("rows")
    stats = scratch.keep(mixed_buckets(marked, s, s.bands), "stats")
    meeting = marked.join(stats.where("not wide"), ["key", "size"]).transform(lambda df: meetings(df, s))
    if not stats.where("wide").isEmpty():
        wide = marked.join(stats.where("wide").select("key", "size"), ["key", "size"])
        wide = scratch.keep(wide.select("id", "comp", "sign").distinct(), "wide")
        rare = scratch.keep(by_rare_members(sets.join(wide.select("id"), "id"), s), "rare")
        several = rare.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        rare = rare.join(several, "key").select("key", F.explode(sizes_met(F.col("n"), F.col("n_shingles"), s)).alias("size"), "id").join(wide, "id")
        rare = scratch.keep(rare.select("key", "size", "id", "comp", "sign"), "cut")
        meeting = meeting.unionByName(rare.join(mixed_buckets(rare, s, None), ["key", "size"]).transform(lambda df: meetings(df, s)))
    marked = grouped(meeting)
    doubtful = marked.mapInArrow(lambda it: _open(it, s), "key long, size int, one int, two int, id long, comp long")
    doubtful = grouped(doubtful.join(sets, "id").select(*GROUP, "id", "comp", "members"))
    final = components(doubtful.mapInArrow(lambda it: _linked(it, s), "a long, b long").union(found), scratch, "two")
    scratch.drop("sets", "marked", "stats", "wide", "rare", "cut", "one*")

    named = classes.select("digest", "id").join(final.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left")
    named = named.select("digest", F.coalesce("root", "id").alias("found"))
    own = base.select("doc_id", "n_shingles", "digest")
    none = own.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    some = own.where("digest is not null").join(named, "digest", "left").select("doc_id", "n_shingles", F.col("found").alias("component_id"))
    return none.unionByName(some).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
