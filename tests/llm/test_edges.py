"""Every operator's defined results for nulls, empty, blank and very long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib

from pyspark.sql import functions as F

from sievelight.llm import chunks, extract, langid, licenses, mixing, neardup, ogg, packing, pii, secrets


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_packing(edge, edge_rows, empty):
    own = packing.pack(edge).collect()
    assert packing.pack(empty).count() == 0
    whole = [r for r in own if r.start == 0]
    assert len(whole) == len(edge_rows)
    assert sum(r.length for r in own) == sum(r.doc_tokens for r in whole)
    assert sum(r.doc_tokens == 1 for r in whole) == 3  # two nulls and the empty text


def test_ogg(edge, edge_rows, empty):
    own = ogg.media_columns(edge).collect()
    assert len(own) == len(edge_rows) and ogg.media_columns(empty).count() == 0
    nothing = [r for r in own if r.n_bytes == 0]
    assert len(nothing) == 3 and {r.payload_bytes for r in nothing} == {576} and {r.payload_sha256 for r in nothing} == {hashlib.sha256(b"\xff" * 576).hexdigest()}


def test_neardup(edge, edge_rows, empty):
    own = neardup.near_duplicates(edge).collect()
    assert len(own) == len(edge_rows) and neardup.near_duplicates(empty).count() == 0
    by = {r.doc_id: r for r in own}
    assert [(r.component_id, r.kept) for r in own if r.doc_id == 2] == [(1, False)] * 2
    assert by[3].n_shingles == by[4].n_shingles == by[5].n_shingles == 0 and by[5].component_id == 5 and by[3].kept
    assert by[8].n_shingles == 1
    assert {(r.n_shingles > 0, r.component_id, r.kept) for r in own if r.doc_id is None} == {(True, None, True), (False, None, True)}


def test_mixing(edge, edge_rows, empty):
    own = mixing.mixed(edge).collect()
    assert len(own) == len(edge_rows) and mixing.mixed(empty).count() == 0
    assert all(0 <= r.taken <= 3 * r.size and (r.taken == 0 if r.size == 0 else r.taken % r.size == 0) for r in own)
    assert sum(r.target for r in {r.source_size: r for r in own}.values()) <= sum(r.size for r in own) + 1e-6
    again = mixing.mixed(edge.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, own))


def test_secrets(spark, edge, empty):
    forest = secrets.fit(spark)
    assert secrets.find(edge, forest=forest).count() == 0 and secrets.find(empty, forest=forest).count() == 0
    same = secrets.redact(edge, forest=forest)
    assert same.columns == edge.columns
    assert sorted(map(repr, same.select("doc_id", "text").collect())) == sorted(map(repr, edge.select("doc_id", "text").collect()))


def test_chunks(edge, edge_rows, empty):
    own = chunks.fingerprints(edge).collect()
    assert len(own) == len(edge_rows) and chunks.fingerprints(empty).count() == 0
    key = lambda r: (-(1 << 63) if r[0] is None else r[0])
    rows = sorted([(r[0], r[1]) for r in edge_rows], key=lambda r: (-key(r), r[1] or ""))
    want = []
    for i, (d, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        h = len(t) // 2
        want.append((d, len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_chars, r.edited_sha256)) for r in own)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in own)


def test_langid(edge, edge_rows, empty):
    own = langid.predict(edge).collect()
    assert len(own) == len(edge_rows)
    none = [r for r in own if r.doc_id in (3, 4, 5, 9)]
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    assert all(r.lang_pred in ("en", "de", "fr") and 0 <= r.score <= 1 for r in own if r.doc_id in (1, 6, 7, 8))
    assert langid.predict(empty).count() == 0
    unlabelled = langid.predict(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert langid.identify(edge, langid.train([])).columns[-3:] == ["lang_pred", "score", "accepted"]


def test_extract(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a"), (4, "u", "no tags at all " * 20), (4, "u", "no tags at all " * 20), (5, "u", "<article><p>" + "word " * 50_000 + "</p>"), (6, "u", "<"), (7, "u", "<!-- never closed <p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    own = extract.extract(df).collect()
    assert len(own) == len(rows) and extract.extract(df.limit(0)).count() == 0
    by = {r.page_id: r for r in own}
    assert by[1].text == by[2].text == by[7].text == "" and by[1].n_chars == 0 and len(by[5].text) == 50_000 * 5 - 1


def test_pii(edge, edge_rows, empty):
    own = pii.pseudonymised(edge).collect()
    assert len(own) == len(edge_rows) and pii.pseudonymised(empty).count() == 0
    assert all(r.n_replaced == 0 for r in own)
    assert sorted(map(repr, ((r.doc_id, r.text) for r in own))) == sorted(map(repr, ((r[0], r[1]) for r in edge_rows)))
    assert pii.pseudonymise(edge).columns.count("n_email") == 1


def test_licenses(edge, empty):
    assert licenses.licences(edge).count() == 0 and licenses.licences(empty).count() == 0


def test_ids_stay(edge):
    for df in (ogg.media_columns(edge), langid.predict(edge), pii.pseudonymised(edge), neardup.near_duplicates(edge), mixing.mixed(edge)):
        assert ids(df) == ids(edge)
