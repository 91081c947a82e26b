"""Resampling, phrases and shards against plain Python, and their results for odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.llm import phrases, resample, shards

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs_of(words, most):
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def features_of(text):
    return runs_of(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)), 3)


def bucket(feature, n=10_000):
    return zlib.crc32(feature.encode()) % n


def plain_resample(rows, target):
    docs = [(d, features_of(t), len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))) for d, t in rows]
    ours = Counter(bucket(x) for _, f, _ in docs for x in f)
    theirs = Counter(bucket(x) for t in target for x in features_of(t))
    s_all, t_all = sum(ours.values()), sum(theirs.values())
    out = []
    for d, f, n in docs:
        w = sum(math.floor(1000 * math.log((theirs[bucket(x)] + 1) * (s_all + 10000) / ((ours[bucket(x)] + 1) * (t_all + 10000)))) for x in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(enough[: 5 * len(enough) // 100]):
        r[4] = i + 1
    return sorted(map(repr, (tuple(r[:5]) for r in out)))


def made(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_resample_is_the_plain_one(spark):
    sf = "/root/testdata/sf0.001"
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_resample([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.select("text").collect()])
    assert made(resample.resample(docs, target)) == want
    assert made(resample.resample(docs.repartition(7), target, resample.Settings(ranges=3, slice_bytes=1000, chunk=2))) == want


def test_resample_of_odd_rows(spark, edge, edge_rows, empty):
    target = spark.createDataFrame([("river stone light",), (None,), ("",)], "text string")
    rows = [r[:2] for r in edge_rows] * 3  # repeated rows, with and without an id
    own = resample.resample(edge.union(edge).union(edge), target)
    assert made(own) == plain_resample(rows, ["river stone light"])
    assert resample.resample(empty, target).count() == 0 and resample.resample(empty, empty).count() == 0
    none = resample.resample(edge, empty)
    assert made(none) == plain_resample([r[:2] for r in edge_rows], [])
    every = resample.Settings(percent=100)
    ids = {r.doc_id for r in resample.drawn(edge, target, every).select("doc_id").collect()}
    assert ids == {r[0] for r in edge_rows if r[0] is not None and len(re.findall(r"\w+", r[1] or "")) >= 20}
    assert resample.drawn(edge, target, every).columns == edge.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aZ9 .-_éß漢😀\x00\n@`{", max_size=40)), max_size=8), st.integers(0, 3))
def test_byte_automaton(texts, skip):
    """Features of any Arrow column, slices of a longer one included, are those of a regular expression."""
    column = pa.array(texts, pa.string()).slice(min(skip, len(texts)))
    words, runs = resample.features(column, resample.Settings())
    want = [features_of(x) for x in column.to_pylist()]
    got = [Counter() for _ in want]
    for row, b in runs:
        for r, x in zip(row.tolist(), b.tolist(), strict=True):
            got[r][x] += 1
    assert got == [Counter(map(bucket, f)) for f in want]
    assert [len(f) for f in want] == [3 * n - min(n, 1) * 3 + (n == 1) if n != 1 else 1 for n in words.tolist()]


@pytest.mark.parametrize("lengths", [[1], [5, 1, 0, 9], [40_000, 3, 70_000, 32_767, 32_766, 2] * 3])
def test_lockstep_checksums(lengths):
    data = np.frombuffer(np.random.default_rng(5).bytes(sum(lengths) + 1), np.uint8)
    length = np.array(lengths)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    state = resample.advance(np.full(len(length), 0xFFFFFFFF, np.uint32), data, start, length)
    assert (state ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, length, strict=True)]


def plain_phrases(rows, s):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(words)
            f.update((lang, x) for x in runs_of(words, s.max_n))
    found = {k: a for k, a in f.items() if " " in k[1] and a >= s.least}
    out = []
    for (lang, p), a in found.items():
        w = p.split(" ")
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((s.scale * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        if not any(g == lang and f" {p} " in f" {q} " and q != p and 100 * b >= s.share * a for (g, q), b in found.items()):
            out.append((lang, -score, -a, p.encode(), p, a, l, r, n[lang], score))
    seen, rows = Counter(), []
    for lang, _, _, _, p, a, l, r, m, score in sorted(out):
        seen[lang] += 1
        if seen[lang] <= s.top:
            rows.append((lang, seen[lang], p, a, l, r, m, score))
    return rows


@pytest.mark.parametrize("s", [phrases.Settings(), phrases.Settings(least=2, top=7, salts=3), phrases.Settings(max_n=4, least=3, share=80), phrases.Settings(max_n=2, least=4)])
def test_phrases_are_the_plain_ones(spark, s):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40 if s.max_n > 3 else 200)
    docs = spark.createDataFrame(docs.select("text", "lang").collect(), "text string, lang string")
    own = [tuple(r) for r in phrases.collocations(docs, s).orderBy("lang", "rank").collect()]
    assert own and own == plain_phrases([tuple(r) for r in docs.collect()], s)


def test_phrases_of_odd_rows(spark, edge, edge_rows, empty):
    s = phrases.Settings(least=2)
    own = [tuple(r) for r in phrases.collocations(edge, s).orderBy("lang", "rank").collect()]
    assert own == plain_phrases([(r[1], r[2]) for r in edge_rows], s)
    assert phrases.collocations(empty).count() == 0
    odd = [("A b\tb  a\x0bc d. A B", None), (" . ,, \t", "x\ty"), ("é é é é\x00 é", "x\ty"), ("a b", "und"), ("漢 字 漢 字", "")]
    own = [tuple(r) for r in phrases.collocations(spark.createDataFrame(odd, "text string, lang string"), s).orderBy("lang", "rank").collect()]
    assert own == plain_phrases(odd, s) and own


def test_only_runs_of_frequent_parts_are_counted(spark):
    """A run of three words becomes a row where both its pairs are frequent, and where its marks clash; that changes no result."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{min(x, 60)}" for x in rng.zipf(1.3, 40)) for _ in range(60)]
    rows = [(x, ["en", "de"][i % 2]) for i, x in enumerate(texts)]
    docs, s, few = spark.createDataFrame(rows, "text string, lang string"), phrases.Settings(least=8), phrases.Settings(least=8, bits=2)
    f = Counter((lang, x) for text, lang in rows for x in runs_of(text.split(" "), 3))
    often = {k for k, a in f.items() if a >= s.least}
    triples = [(lang, x) for lang, x in f.elements() if x.count(" ") == 2]
    want = Counter((lang, x) for lang, x in triples if (lang, x.rsplit(" ", 1)[0]) in often and (lang, x.split(" ", 1)[1]) in often)
    found = spark.createDataFrame([(lang, x, 2, f[lang, x]) for lang, x in often if x.count(" ") == 1], "lang string, phrase string, words int, f long")
    made = lambda s: Counter(tuple(r.key.split("\t"))[::-1] for r in phrases.longer(docs, found, 3, s).collect())
    assert made(s) == want and 0 < want.total() < len(triples) / 2
    assert made(few) == Counter(triples)
    own = [[tuple(r) for r in phrases.collocations(docs, x).orderBy("lang", "rank").collect()] for x in (s, few)]
    assert own[0] == own[1] == plain_phrases(rows, s) and any(p.count(" ") == 2 for _, _, p, *_ in own[0])


def test_scores_are_exact(spark):
    """Products beyond 64 bits, with a remainder that a double would lose."""
    a, l, r = 3_000_000_019, 6_000_000_037, 9_000_000_059
    found = spark.createDataFrame([("x", "p q", 2, a), ("x", "p", 1, l), ("x", "q", 1, r)], "lang string, phrase string, words int, f long")
    assert phrases.scored(found).first().score == 1_000_000 * a * a // (l * r)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 100, 1001])
def test_permutation(spark, n):
    s = shards.Settings(seed=n)
    rows = spark.range(n).select("id", shards.permuted(F.col("id"), n, s).alias("at")).withColumn("back", shards.restored(F.col("at"), n, s)).collect()
    assert sorted(r.at for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n > 100:
        assert sum(r.at == r.id for r in rows) < 10 and [r.at for r in rows] != sorted(r.at for r in rows)


def digest(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain_place(x, n, s):
    a, b = shards.sides(n)
    while True:
        left, right = divmod(x, b)
        for i in range(s.rounds):
            if i % 2 == 0:
                left = (left + digest(s.seed, i, right)) % a
            else:
                right = (right + digest(s.seed, i, left)) % b
        x = left * b + right
        if x < n:
            return x


def test_shards_are_the_plain_ones(spark, edge, edge_rows, empty):
    s = shards.Settings(shards=5, chunk=2)
    rows = [r[:2] for r in edge_rows] * 4
    own = shards.assigned(edge.union(edge).union(edge).union(edge).repartition(6), s).collect()
    plain = sorted(((digest("" if d is None else d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())), d, t) for d, t in rows), key=lambda x: x[0])
    want = []
    for number, (_, d, t) in enumerate(plain):
        at = plain_place(number, len(plain), s)
        want.append((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "rows", at % 5, at // 5, None))
    assert sorted(map(repr, map(tuple, own))) == sorted(map(repr, want))
    assert shards.assigned(empty).count() == 0


def test_shards_on_disk(spark, edge, tmp_path):
    """Files hold whole rows, each shard in the order of its slots without a gap; counts differ by one at most; a repeated run agrees."""
    s = shards.Settings(shards=3)
    for k in range(2):
        shards.write(edge.drop("rank"), ["doc_id", "text"], str(tmp_path / f"out{k}"), s)
    one, two = (spark.read.parquet(str(tmp_path / f"out{k}")) for k in range(2))
    rows = one.orderBy("shard", "slot").collect()
    assert rows == two.orderBy("shard", "slot").collect()
    slots = {k: [r.slot for r in rows if r.shard == k] for k in range(3)}
    assert all(v == list(range(len(v))) for v in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(repr, (r.row for r in rows))) == sorted(map(repr, edge.drop("rank").collect()))


def test_shards_stay_in_the_engine(spark, edge):
    """[native]: no Python worker anywhere on the way."""
    df = shards.assigned(edge)
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()
