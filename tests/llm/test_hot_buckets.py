"""Large groups in one bucket: exact components whatever the blocks, and rows in proportion to the group."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelight.llm import neardup


def plain_sets(texts):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def plain_components(texts, percent=85):
    sets = plain_sets(texts)
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]


def family(rng, n, words, changes):
    """n texts that are each a few changes away from one text."""
    base = [f"w{rng.randrange(10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(*changes)):
            own[rng.randrange(words)] = f"x{rng.randrange(10_000)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [4, 32, 256])
def test_components_with_small_blocks(spark, block):
    """A group of near copies, a template whose texts are mostly just below the bar, and texts of their own, in blocks of few rows: buckets of
    several components are met block by block, and at four rows a block by their rarest members."""
    rng = random.Random(block)
    texts = family(rng, 150, 120, (0, 1)) + family(rng, 260, 120, (1, 4)) + family(rng, 40, 30, (0, 3)) + [f"own text number {i} has seven words" for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, neardup.Settings(block=block)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(texts)


def bucket(spark, n, others):
    """One bucket of n rows, of which `others` are components of their own."""
    return spark.range(n).select(F.lit(1).cast("long").alias("key"), F.lit(-1).alias("size"), "id", F.when(F.col("id") < n - others, 0).otherwise(F.col("id")).cast("long").alias("comp"), F.lit(b"x").alias("sign"))


@pytest.mark.parametrize("others", [1, 100, 256, 2000])
def test_rows_grow_with_the_group(spark, others):
    """Rows that a bucket of 20 000 and one of 40 000 are dealt to: twice as many, and never more than 50 for each row."""
    s = neardup.Settings()
    rows = []
    for n in (20_000, 40_000):
        df = bucket(spark, n, others)
        met = neardup.meetings(df.join(neardup.mixed_buckets(df, s, s.bands), ["key", "size"]), s)
        rows.append(met.count())
        groups = met.groupBy("one", "two").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b"))
        assert groups.agg(F.max("n")).first()[0] < 5 * s.block
    assert rows[1] < 2.2 * rows[0] and rows[0] < 50 * 20_000


def test_every_pair_of_components_meets(spark):
    s = neardup.Settings(block=8)
    for n, others in ((50, 3), (50, 20), (60, 59), (8, 4), (9, 1)):
        df = bucket(spark, n, others)
        met = neardup.meetings(df.join(neardup.mixed_buckets(df, s, None), ["key", "size"]), s).select("one", "two", "id", "comp").collect()
        groups = {}
        for r in met:
            groups.setdefault((r.one, r.two), []).append((r.id, r.comp))
        seen = {frozenset((a, b)) for g in groups.values() for a, x in g for b, y in g if x != y}
        own = {r.id: r.comp for r in df.collect()}
        assert seen == {frozenset((a, b)) for a in own for b in own if own[a] != own[b]}


def template(rng, n, common, own):
    """n texts of one template, of whose shingles each has `own` by itself at its end."""
    head = [f"t{i}" for i in range(common + 4)]
    return [" ".join(head + [f"o{rng.randrange(1 << 40)}" for _ in range(own)]) for _ in range(n)]


def test_a_wide_template_loses_no_link(spark):
    """Pages with 75 % in common, most of them unlike, in buckets far wider than `bands` blocks; copies of some with one or two words changed."""
    rng = random.Random(3)
    texts = template(rng, 600, 90, 15)
    for i in range(0, 120, 3):
        words = texts[i].split()
        words[-1 - i % 4] = "changed"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, neardup.Settings(block=4)).collect()}
    want = plain_components(texts)
    assert [got[i] for i in range(len(texts))] == want and 400 < len(set(want)) < len(texts)


def members(spark, n, linked):
    """n sets of 100 members, 75 of which are everybody's; of the first `linked` sets each odd one has 20 more of the set before it."""
    def made(batches):
        for b in batches:
            for i in b.column("id").to_pylist():
                own = i - 1 if i < linked and i % 2 else i
                x = [*range(75), *range(1000 * own + 100, 1000 * own + 120), *range(1000 * i + 200, 1000 * i + 205)]
                yield pa.RecordBatch.from_pydict({"id": [i], "members": [np.array(x, np.int64).tobytes()]})

    return spark.range(n).mapInArrow(made, "id long, members binary")


@pytest.mark.parametrize("n", [20_000, 40_000])
def test_unlike_rows_of_a_template_do_not_meet(spark, n):
    """Of n sets of one bucket, nearly all unlike, only those that share rare members stand under a key: rows written grow with the links, not with the square."""
    rare = neardup.by_rare_members(members(spark, n, 1000), neardup.Settings()).toPandas()
    keys = rare.groupby("key").id.agg(["size", "min", "max"])
    assert len(rare) <= 1000 * 16 and keys["size"].max() == 2
    assert sorted(set(keys["min"])) == list(range(0, 1000, 2)) and (keys["max"] - keys["min"] == 1).all()


def test_links_share_a_rare_member(spark):
    """Random sets over few members: each pair that is a link stands under a key together, whatever the frequencies."""
    rng, rows = random.Random(9), []
    for i in range(300):
        base = rows[rng.randrange(len(rows))][1] if rows and rng.random() < 0.6 else {min(int(rng.paretovariate(0.4)), 1 << 40) for _ in range(rng.randint(6, 60))}
        rows.append((i, set(base) ^ {rng.randrange(1, 90) for _ in range(rng.randint(0, 4))}))
    df = spark.createDataFrame([(i, b"".join(x.to_bytes(8, "little") for x in sorted(v))) for i, v in rows], "id long, members binary")
    under = {}
    for r in neardup.by_rare_members(df, neardup.Settings()).collect():
        under.setdefault(r.key, set()).add(r.id)
    links = [(i, k) for i, x in rows for k, y in rows if i < k and 100 * len(x & y) >= 85 * len(x | y)]
    assert len(links) > 30 and all(any({i, k} <= g for g in under.values()) for i, k in links)


def test_a_wide_bucket_is_marked(spark):
    s = neardup.Settings(block=8)
    for others, wide in ((8 * 24, False), (8 * 24 + 1, True)):
        assert neardup.mixed_buckets(bucket(spark, 500, others), s, s.bands).first().wide == wide
    assert neardup.mixed_buckets(bucket(spark, 500, 0), s, s.bands).count() == 0
