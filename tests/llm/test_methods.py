"""Each operator's method against brute force, an exact round trip or held-out rows."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelight.llm import chunks, extract, langid, licenses, mixing, neardup, ogg, packing, pii, secrets
from tests.llm.conftest import sentence

SF = "/root/testdata/sf0.01"


# Packing ------------------------------------------------------------------------------------------------------------------------


def test_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, theirs = packing.encoder(path), Tokenizer.from_file(path)
    for t in ("", " ", "Hello world's  end\n\n x", "naïve ß 漢字 😀", "<|endoftext|> a<|endoftext|>", "a" * 3000, " \t\n\r\x0b", "12345 67", sentence(1, 500)):
        assert own(t).tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_knapsack_equals_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        widths = np.array(sorted(rng.sample(range(1, 15), 4)))
        prices = np.array([rng.random() for _ in widths])
        worth, counts = packing.best_pattern(prices, widths, 20)
        best = max(sum(p * c for p, c in zip(prices, x, strict=True)) for x in np.ndindex(*[20 // w + 1 for w in widths]) if sum(c * w for c, w in zip(x, widths, strict=True)) <= 20)
        assert abs(worth - best) < 1e-9 and (counts * widths).sum() <= 20 and abs((counts * prices).sum() - worth) < 1e-9


def test_patterns_meet_the_demand():
    widths, demand = np.array([3, 5, 7, 11]), np.array([40.0, 30.0, 25.0, 9.0])
    found = packing.patterns(widths, demand, 20, 1e-9, 1000)
    total = sum(x * c for x, c in found)
    assert np.allclose(total, demand) and all((c * widths).sum() <= 20 for _, c in found)
    assert sum(x for x, _ in found) <= (widths * demand).sum() / 20 * 1.05


def test_patterns_come_near_the_best():
    """Against all patterns of small problems: the linear program over every pattern, solved by trying all bases."""
    import itertools
    import warnings

    rng = random.Random(2)
    for _ in range(30):
        size = rng.randint(6, 12)
        widths = np.array(sorted(rng.sample(range(2, size), min(3, size - 2))))
        demand = np.array([float(rng.randint(1, 30)) for _ in widths])
        every = [c for c in itertools.product(*[range(size // w + 1) for w in widths]) if any(c) and sum(a * w for a, w in zip(c, widths, strict=True)) <= size]
        best = np.inf
        for basis in itertools.combinations(every, len(widths)):
            m = np.array(basis, float).T
            if abs(np.linalg.det(m)) > 1e-9 and (x := np.linalg.solve(m, demand)).min() >= -1e-9:
                best = min(best, x.sum())
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            got = packing.patterns(widths, demand, size, 5e-4, 4000)
        assert best - 1e-6 <= sum(u for u, _ in got) <= best * (1 + 5e-4) + 1e-6
        assert np.allclose(sum(u * c for u, c in got), demand)


def test_rounds_that_end_early_are_told():
    widths, demand = np.arange(2, 40), np.arange(2, 40).astype(float)
    with pytest.warns(UserWarning, match="above the lower bound"):
        got = packing.patterns(widths, demand, 97, 1e-6, 3)
    assert np.allclose(sum(u * c for u, c in got), demand)


def test_inverse():
    a = np.random.default_rng(1).normal(size=(7, 7))
    assert np.allclose(packing.inverted(a) @ a, np.eye(7))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=200))
def test_every_piece_has_one_place(classes):
    s = packing.Settings()
    histogram = {c: classes.count(c) for c in classes}
    p = packing.plan(histogram, s)
    load: dict[int, int] = {}
    for c, n in histogram.items():
        for x in p.place(np.full(n, c), np.arange(n)):
            load[int(x)] = load.get(int(x), 0) + c
    assert max(load.values()) <= 256 and sorted(load) == list(range(p.sequences))
    assert p.sequences <= 1.2 * sum(classes) / 256 + 2


def test_pack_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = packing.pack(docs).collect()
    encode = packing.encoder(packing.default_tokenizer())
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sequences: dict[int, list] = {}
    for r in own:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = np.append(encode(texts[r.doc_id]).astype("<u4"), np.uint32(1)).astype("<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert {d: sum(r.length for r in own if r.doc_id == d) for d in list(texts)[:50]} == {d: next(r.doc_tokens for r in own if r.doc_id == d) for d in list(texts)[:50]}
    waste = 0
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    assert waste < 0.02 * sum(r.length for r in own)


# Ogg ----------------------------------------------------------------------------------------------------------------------------------


def plain_checksum(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
def test_checksum_equals_bitwise(data):
    assert ogg.checksum(data) == plain_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=1200), min_size=1, max_size=12), st.lists(st.binary(max_size=700), min_size=1, max_size=6), st.integers(1, 255))
def test_demux_returns_what_mux_took(a, b, segments):
    ends = lambda p: [100 * (i + 1) for i in range(len(p))]
    found = ogg.demux(ogg.mux({7: (a, ends(a)), 9: (b, ends(b))}, segments))
    assert found[7].packets == a and found[9].packets == b
    assert found[7].times(100)[-1] == len(a) and all(g in (-1, *ends(a)) for g in found[7].granules)


@given(st.binary(max_size=4000))
def test_payload_round_trip(data):
    payload = ogg.pad(data)
    assert len(payload) % 576 == 0 and len(payload) > 0 and ogg.decode(ogg.encode(payload))[0] == payload


def test_damage_is_found():
    media = bytearray(ogg.encode(ogg.pad(sentence(1, 4000).encode())))
    media[len(media) // 3] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.decode(bytes(media))
    assert sum(s.bad_pages for s in ogg.demux(bytes(media), strict=False).values()) >= 1


# Near-duplicates ----------------------------------------------------------------------------------------------------------------------


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_sets_equal_plain_python():
    texts = ["", " a ", "A b C d E f", "É a\tb\x0bc d e", "x x x x x x x", sentence(3, 400), "a b c d e" * 3, "one two three", " \n"]
    assert [len(x) for x in neardup.shingle_sets(texts, 5)] == [len(plain_set(t)) for t in texts]
    a, b = neardup.shingle_sets(["The quick brown fox jumps", " the QUICK brown fox\njumps "], 5)
    assert a.tolist() == b.tolist()


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for share in (0.5, 0.85, 0.95):
        n = int(400 * 2 * share / (1 + share))
        other = np.concatenate([base[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64)])
        s = neardup.superminhash([np.unique(base), np.unique(other)], 512)
        j = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
        assert abs((s[0] == s[1]).mean() - j) < 0.07
    one = neardup.superminhash([np.array([5], np.uint64)], 64)[0]
    assert sorted(x >> np.uint64(32) for x in one) == list(range(64))  # one element fills each slot by a step of its own


@pytest.mark.parametrize("most", [1 << 20, 200, 7])
def test_exact_links_join_what_any_link_joins(most):
    rng = random.Random(2)
    base = [rng.randrange(1 << 60) for _ in range(60)]
    sets = [np.unique(np.array([x if rng.random() > 0.08 else rng.randrange(1 << 64) for x in base], np.uint64)) for _ in range(25)]
    up = list(range(25))
    for i in range(25):
        for k in range(i):
            n = len(np.intersect1d(sets[i], sets[k]))
            if 100 * n >= 85 * (len(sets[i]) + len(sets[k]) - n):
                a, b = up[i], up[k]
                up = [min(a, b) if x in (a, b) else x for x in up]
    got = list(range(25))
    for i, k in neardup.exact_links(sets, np.arange(25), 85, most):
        a, b = got[i], got[k]
        got = [min(a, b) if x in (a, b) else x for x in got]
    assert got == up


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = sentence(100 + g, 120).split() if g % 2 else [f"{w}{i}" for i, w in enumerate(sentence(g, 150).split())]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, 7)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            rows.append(" ".join(w))
    passage = sentence(77, 60)
    rows += [f"{sentence(500 + i, 20)} {passage} {sentence(900 + i, 30)}" for i in range(60)] + ["", None, "a b", "A B"]
    rng.shuffle(rows)
    sets = [plain_set(t) for t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= 85 * len(sets[i] | sets[k]):
                a, b = root(i), root(k)
                up[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for s in (neardup.Settings(), neardup.Settings(block=8)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, s).collect()}
        assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(rows))}


# Mixing -------------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=8), st.floats(0, 1))
def test_fit_is_nearest(histogram, part):
    lengths = np.array(sorted(histogram))
    counts = np.array([histogram[x] for x in lengths])
    total = int((lengths * counts).sum())
    budget = part * total
    taken = mixing.fit(lengths, counts, budget)
    assert ((0 <= taken) & (taken <= counts)).all()
    sums = {0}
    for x, n in histogram.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    best = min(abs(round(budget) - s) for s in sums)
    assert abs(round(budget) - int((lengths * taken).sum())) <= best + int(lengths[-1]) * 0.5


def test_targets_equal_a_loop(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 9):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 1, 50, 1000, 100_000]) for i in range(n)}
        order = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        total, target, free = sum(sizes.values()), {}, set(order)
        while free:
            rest, w = total - sum(target.values()), sum(weight[s] for s in free)
            over = {s for s in free if rest * weight[s] / w >= 3 * sizes[s]}
            if not over:
                target |= {s: rest * weight[s] / w for s in free}
                break
            target |= {s: 3.0 * sizes[s] for s in over}
            free -= over
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 * max(1, total) for s in got), (sizes, got, target)


def test_mix_meets_targets(spark):
    own = mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    by: dict[float, list] = {}
    for r in own:
        by.setdefault((r.source_size, r.target), []).append(r)
    for (size, target), rows in by.items():
        assert size == sum(r.size for r in rows) and abs(sum(r.taken for r in rows) - target) <= 0.001 * target + 1 and max(r.taken - 3 * r.size for r in rows) <= 0


# Secrets ------------------------------------------------------------------------------------------------------------------------------


def test_forest_expression_equals_its_votes(spark):
    from pyspark.sql import functions as F

    x = np.random.default_rng(1).random((200, 3))
    forest = secrets.grow(x, (x[:, 0] > x[:, 1]).astype(float), secrets.Settings(trees=5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = df.select("a", "b", "c", secrets.expression(forest, [F.col(c) for c in "abc"]).alias("v")).collect()
    assert all(abs(r.v - secrets.vote(forest, [r.a, r.b, r.c])) < 1e-12 for r in got)


def test_secrets_found_and_decoys_left(spark):
    rng = random.Random(8)
    h = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    bad = [f'see token = "{h(40)}" here', f"and password={h(18)} and", f"x AKIA{''.join(rng.choices('ABCDEFGHJKLMNPQRSTUVWXYZ234567', k=16))} y", f"api_key: {h(32)}"]
    good = [f"commit {h(40)}", "card 4984250489669609 ok", "call +1 (988) 555-2485", f"sha256: {h(64)}", "/usr/share/docs/readme2/index3/page44", "mail first.last22@mail6.example.com", sentence(4, 60), "2024-01-12T10-22-00-build"]
    docs = spark.createDataFrame(list(enumerate(bad + good)), "doc_id long, text string")
    forest = secrets.fit(spark)
    found = secrets.find(docs, forest=forest).collect()
    assert sorted({r.doc_id for r in found}) == list(range(len(bad)))
    texts = {r.doc_id: r.text for r in secrets.redact(docs, forest=forest).collect()}
    for r in found:
        text = (bad + good)[r.doc_id]
        assert texts[r.doc_id] == text[: r.start] + secrets.MASK + text[r.start + r.length :]
    assert [texts[i] for i in range(len(bad), len(bad + good))] == good


# Chunks -------------------------------------------------------------------------------------------------------------------------------


def plain_cut(data: bytes, s: chunks.Settings) -> list[bytes]:
    gear, out, start, h, bits = chunks._gear(s.seed).tolist(), [], 0, 0, s.normal.bit_length() - 1
    for i, byte in enumerate(data):
        h = (h << 1) + gear[byte] - (gear[data[i - 16]] << 16 if i >= 16 else 0)
        n = i - start + 1
        strict, loose = h & 0xFFFFFFFF < 1 << 32 - bits - 2, h & 0xFFFFFFFF < 1 << 32 - bits + 2
        if n == s.most or n >= s.normal and loose or s.least <= n < s.normal and strict:
            out.append(data[start : i + 1])
            start = i + 1
    return out + [data[start:]] * (start < len(data))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=4))
def test_cut_equals_bytewise(seeds):
    s = chunks.Settings()
    texts = [sentence(x, x % 700).encode() for x in seeds]
    joined = b"".join(texts)
    starts, ends, first = chunks.cut(texts, s)
    for k, t in enumerate(texts):
        got = [joined[a:z] for a, z in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
        # The bytewise hash starts anew with each text; after the least length both windows hold the text's bytes alone.
        assert got == plain_cut(t, s)


def test_chunks_resist_shifts():
    a = sentence(1, 3000)
    p, q, r = chunks.prints([a.encode(), ("Inserted words. " + a).encode(), sentence(2, 3000).encode()])
    assert chunks.containment(p, q) > 0.95 and chunks.containment(p, p) == 1 and chunks.containment(p, r) < 0.05
    for seed in range(200):  # of a text of 200 characters the first quarter or half stays
        short, other = sentence(seed, 400)[:200], sentence(seed + 1000, 400)
        own, quarter, half = chunks.prints([x.encode() for x in (short, short[:50] + other[:150], short[:100] + other[:100])])
        assert len(own[0]) >= 4 and chunks.containment(own, quarter) > 0.05 and chunks.containment(own, half) > 0.2
    half = chunks.edited(a, sentence(3, 3000))
    assert 0.4 < chunks.containment(p, chunks.prints([half.encode()])[0]) < 0.55


# Languages, licences, pages, PII --------------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    own = langid.predict(docs).collect()
    held = [r for r in own if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in own)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held) and len(own) == len(lang)


def test_licence_templates():
    model = licenses.train()
    for family, templates in licenses.TEMPLATES.items():
        for t in templates:
            text = f"{sentence(1, 40)}\n{t.capitalize()}.\n{sentence(2, 30)}"
            found = licenses.scan(text, model)
            assert [x[2] for x in found] == [family], t
            assert text[found[0][0] :].lower().startswith(t.split()[0])
    for t in licenses.OTHERS:
        assert licenses.scan(t, model) == []


def test_main_text_of_pages():
    tree = extract.grow(*extract.labelled())
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header class='site'><a href=/>Home</a></header><nav><ul><li><a href=1>One</a></ul></nav><div id='cookie-consent'>We use cookies. <button>OK</button></div>"
        "<main><article class=post><header><h1>The &amp; title</h1></header><p>Be.</p><p>One <b>two</b>three&nbsp;x &lt;b&gt;</p><div class='ad'>Buy this now</div><script>var a='</p>'</script>"
        "<section class=comments><p>I like this long comment with very many words in it, more than most have.</p></section></article></main><aside>Side</aside><form>Name <input></form><footer>&copy; x</footer></body></html>"
    )
    assert extract.main_text(page, tree) == "The & title Be. One twothree x <b>"


def test_pages_equal_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    tree = extract.grow(*extract.labelled())
    for r in pages:
        body = r.html[r.html.find("<article>") : r.html.rfind("</article>")]
        want = " ".join(html.unescape(re.sub(r"<(?!/?b>)[^<>]*>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert extract.main_text(r.html, tree) == want


def test_pseudonyms():
    s = pii.Settings(key=b"a key of the test")
    text = "mail Ab.c9@mail6.example.com, card 4984250489669609 or 4984 2504 8966 9609, phone +1 (988) 555-2485, ip 53.183.220.240, on 2024-02-29 or 24.12.1999, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00"
    new, found = pii.replace(text, s)
    assert [k for k, _, _ in found] == ["email", "card", "card", "phone", "ipv4", "date", "date", "ssn", "iban"]
    assert all(text[a : a + n] not in new for _, a, n in found) and pii.restore(new, s) == text
    a, b = re.findall(r"\d{16}|\d{4} \d{4} \d{4} \d{4}", new)[:2]
    assert a == b.replace(" ", "") and pii.luhn(a) == 0
    assert pii.replace("4984250489669608 and 999.1.1.1 and 2024-02-31", s) == ("4984250489669608 and 999.1.1.1 and 2024-02-31", [])
    assert pii.replace(text, pii.Settings(key=b"other"))[0] != new


@given(st.lists(st.tuples(st.integers(2, 30), st.integers(0, 29)), min_size=1, max_size=12))
def test_permutation_inverts(pairs):
    radix = tuple(r for r, _ in pairs)
    x = tuple(v % r for r, v in pairs)
    y = pii.permuted(x, radix, "t", pii.Settings(b"k"))
    assert all(0 <= v < r for v, r in zip(y, radix, strict=True)) and pii.permuted(y, radix, "t", pii.Settings(b"k"), True) == x


def test_permutation_is_one_to_one():
    got = {pii.permuted((a, b, c), (5, 7, 4), "t", pii.Settings(b"k")) for a in range(5) for b in range(7) for c in range(4)}
    assert len(got) == 5 * 7 * 4
