"""The pipeline's stages against plain Python, row by row, each on what the one before it kept."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from sievelight.llm import langid, mixing, packing, secrets
from sievelight.llm.common import table

from .test_hot_buckets import plain_components
from .test_secrets import plain

SF = "/root/testdata/sf0.001"
EXTRA = [
    (900_001, "Мой дом стоит у моря и каждое утро я гуляю по пляжу с собакой.", "en", "src1", 60),
    (900_002, None, "en", "src1", 0), (900_003, "12345 67890", "en", None, 11), (900_004, "", "en", "src2", 0),
]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, as lists of rows."""
    docs = table(spark, SF, "documents")
    some = docs.limit(40).withColumn("doc_id", F.col("doc_id") + 500_000).withColumn("text", F.concat(F.col("text"), F.lit(" and a token=aX9kQ7bR2mZ4 here")))
    docs = docs.unionByName(spark.createDataFrame(EXTRA, docs.schema)).unionByName(some)
    top, out = tmp_path_factory.mktemp("stages"), {}
    docs.write.parquet(str(top / "in"))
    docs = spark.read.parquet(str(top / "in"))
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(top / name))
        after = spark.read.parquet(str(top / name))
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language(stages):
    before, after = stages["language"]
    model = langid.fit(before)
    want = []
    for r in rows(before):
        lang, score = model.predict([r[1] or ""])
        if lang[0] != "und" and score[0] >= model.threshold:
            want.append(r)
    assert rows(after) == want and {r[0] for r in rows(before)} - {r[0] for r in want} >= {900_001, 900_002, 900_003, 900_004}


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    own = sorted(rows(before))
    texts = [re.sub(r"[A-Z]", lambda m: m[0].lower(), r[1]) for r in own]
    split = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    found = plain_components(split)
    assert rows(after) == sorted((r for i, r in enumerate(own) if found[i] == i), key=repr) and len(own) > len(rows(after))


def test_secret_scan(spark, stages):
    before, after = stages["secret_scan"]
    forest, want = secrets.fit(spark), []
    for r in rows(before):
        t = r[1]
        for a, n, _ in reversed(plain(t, forest)):
            t = t[:a] + secrets.MASK + t[a + n :]
        want.append((r[0], t, r[2], r[3], len(t)))
    assert rows(after) == sorted(want, key=repr) and any(secrets.MASK in r[1] for r in want)


def test_mix_sources(stages):
    before, after = stages["mix_sources"]
    s = mixing.Settings()
    hashed = {r[0]: r[1] for r in before.select("doc_id", F.xxhash64(F.lit(s.seed), "doc_id")).collect()}
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for r in rows(before):
        by[r[3]].append(r)
    order = sorted((x for x in by if x is not None)) + ([None] if None in by else [])
    total = {x: sum(size(r[1]) for r in by[x]) for x in order}
    weight = {x: s.weights[i % len(s.weights)] for i, x in enumerate(order)}
    target, free = {}, set(order)
    while free:
        rest, w = sum(total.values()) - sum(target.values()), sum(weight[x] for x in free)
        over = {x for x in free if rest * weight[x] / w >= s.most * total[x]}
        target |= {x: float(s.most * total[x]) for x in over} if over else {x: rest * weight[x] / w for x in free}
        free = free - over if over else set()
    want = Counter()
    for x in order:
        if not total[x]:
            continue
        whole = int(target[x] // total[x])
        lengths = sorted({size(r[1]) for r in by[x]} - {0})
        counts = np.array([sum(size(r[1]) == n for r in by[x]) for n in lengths])
        more = mixing.fit(np.array(lengths), counts, target[x] - whole * total[x])
        for n, k in zip(lengths, more, strict=True):
            for i, r in enumerate(sorted((r for r in by[x] if size(r[1]) == n), key=lambda r: (hashed[r[0]], r[0]))):
                want[r] += whole + (i < k)
    assert Counter(rows(after)) == +want
    taken = Counter()
    for r, n in want.items():
        taken[r[3]] += n * size(r[1])
    assert all(abs(taken[x] - target[x]) <= max(size(r[1]) for r in by[x]) / 2 + 1 for x in order)


def test_pack(stages):
    """Every document's ids lie in its pieces in order, sequences have no gaps, and there are hardly more of them than tokens fill."""
    before, after = stages["pack"]
    encode, size = packing.encoder(packing.default_tokenizer()), packing.Settings().size
    want = Counter()
    for r in rows(before):
        ids = np.append(encode(r[1]).astype("<u4"), np.uint32(1)).astype("<u4")
        want.update((r[0], a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes()), len(ids)) for a in range(0, len(ids), size))
    pieces = after.collect()
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert len(sequences) <= 1.02 * sum(p.length for p in pieces) / size + 3
