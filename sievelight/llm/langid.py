"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes of the lower-cased text,
within words, with one blank as word edge); a linear layer and a softmax give the languages. Both are
trained by stochastic gradient descent in numpy, on the driver, on a sample of labelled rows: as many of each language, about
`Settings.sample_rows` in all, but `Settings.least_rows` of a language where there are so many, for at most `Settings.most_langs` languages. As the mean is linear,
prediction needs only one row of logits for each bucket: a table of `buckets` x languages, which doesn't grow with the corpus.

A softmax must choose one of its languages, so its score alone rejects little. A second factor tells whether the text is in a learned language at
all: the share of its 4-byte n-grams that training never met. A logistic curve over that share is calibrated on pieces of texts that training
doesn't see against `background`, pieces made by rule: letters out of order, random letters, other scripts, code, words of languages that
aren't learned. A score is the softmax's (with a temperature fitted on the unseen texts) times that curve. What scores below the threshold is
rejected: `Settings.sure`, or less if over `Settings.lost` of the unseen whole texts would go. Texts of a few n-grams lean to the
usual share, so what is too short to tell stays.

Defined cases: a null or empty text, or one without letters, is `und` with score 0 and rejected, as is every
text if nothing is labelled. Whole texts are read, however long. Equal texts get equal results. A null id is
never held out. Extra columns are kept by `identify` and ignored by `predict`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_rows, text_sizes, texts_of

UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(32 if i < 65 or 91 <= i < 97 or 123 <= i < 128 else i for i in range(256))
_MARK = np.array([48 <= i < 58 or i == 64 for i in range(256)])
_RUN = _MARK | np.array([65 <= i < 91 or 97 <= i < 123 or chr(i) in "._+-" for i in range(256)])
WIDE = 21
_MULT = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 2500
    least_rows: int = 50
    most_langs: int = 500
    held_out: float = 0.25
    bits: int = 15
    dim: int = 16
    epochs: int = 4
    rate: float = 20.0
    seed: int = 11
    words: tuple[int, ...] = (3, 8, 20, 60)
    pieces: int = 12
    lost: float = 0.001
    sure: float = 0.3
    lean: float = 12.0  # n-grams of the usual share that are added to a text's own


#: Frequent words of languages, for those that aren't learned; the first and last letters of scripts; words of code.
FREQUENT = {
    "it": "della sono anche come questo più nella essere stato perché dopo molto quando gli alla dove ogni città giorno lavoro", "pt": "não uma para com mais como foi pelo seus também quando muito depois entre cidade trabalho você isso está manhã",
    "pl": "nie jest się dla jego przez tylko jak oraz już może czy który kiedy miasto dzień pracy każdego bardzo przed", "nl": "het een niet voor met zijn door maar ook naar wordt deze over heeft tegen moeten tijd werk waar onder",
    "sv": "och att det som inte för med den till har från eller efter kan skulle mycket varje arbete stad när", "cs": "není jsem také které jeho před podle jako město práce každý velmi když byl může protože ještě mezi nebo den",
    "fi": "että hän ovat mutta myös joka sitten kuin hänen oli vuonna kaupunki työ päivä ennen hyvin kaikki mukaan eivät", "hu": "hogy nem volt egy mint csak még már meg után lehet város munka nap minden nagyon előtt között szerint ezt",
    "tr": "bir ve bu için ile olarak daha çok gibi sonra kadar olan değil şehir gün her önce ancak yılında iş", "ro": "este sunt pentru care mai din lui după între oraș muncă zi foarte când până acest fost poate fiecare însă",
    "la": "est omnis quarum unam aliam qui ipsorum inter sunt autem enim quod cum esse atque neque ab ad per post", "en": "the and that with this from which have been their would there about after before every work city people because",
    "de": "und der die das nicht mit auf ist ein eine auch werden nach durch immer stadt arbeit jeden vor weil", "fr": "les des est pas que pour dans avec une sur plus par mais tout après avant ville travail jour parce", "es": "que los del una con por para las como más pero sus este ciudad trabajo cada antes después porque muy",
}
SCRIPTS = ("αω", "ая", "את", "بي", "अह", "กฮ", "ぁん", "ァン", "一龥", "가힣", "აჰ", "աֆ")
CODE = "def return import self for in range print if else elif while try except class function const let var public static void int string null true false new this async await lambda yield struct enum switch case break foreach".split()


def background(pieces: list[str], langs: list[str], rng: np.random.Generator) -> list[str]:
    """As many pieces in none of the languages: the given ones with their letters out of order, and others made by rule."""
    words = [w.split() for x, w in FREQUENT.items() if x not in langs]
    spans = [(ord(x[0]), ord(x[-1])) for x in SCRIPTS]
    out = []
    for i, p in enumerate(pieces):
        n = max(3, len(p.split()))
        match i % 5:
            case 0:
                letters = [c for c in p.lower() if c.isalpha()]
                rng.shuffle(letters)
                it = iter(letters)
                out.append("".join(next(it) if c.isalpha() else c for c in p.lower() if not c.isalpha() or len(c.lower()) == 1))
            case 1:
                out.append(" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxzaeiouy"), rng.integers(2, 9))) for _ in range(n)))
            case 2:
                a, z = spans[rng.integers(len(spans))]
                out.append(" ".join("".join(chr(x) for x in rng.integers(a, z + 1, rng.integers(2, 8))) for _ in range(n)))
            case 3:
                own = words[rng.integers(len(words))] if words else list(CODE)
                out.append(" ".join(rng.choice(own, n)))
            case _:
                out.append(" ".join(f"{rng.choice(CODE)}{rng.choice(['(', ' = ', '.', ': ', '_'])}{rng.choice(CODE)}" for _ in range(n)))
    return out


def subwords(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram of all texts (the last bucket + 1 for what isn't one), the first index of each text, and the place of
    each n-gram of four bytes among `1 << WIDE` (-1 for what isn't one).

    There are three n-grams for each byte; texts lie apart by blanks, which no n-gram crosses.
    """
    raw = [b"  " + t.lower().encode() + b"  " for t in texts]
    joined = b"".join(raw) + b"    "
    b = np.frombuffer(joined, np.uint8)
    # Runs with a digit or an @ in them (keys, numbers, addresses) are no words.
    run = np.cumsum(~_RUN[b], dtype=np.int32)
    marked = np.bincount(run, weights=_MARK[b]) > 0
    b = np.where(marked[run], 32, np.frombuffer(joined.translate(_BLANK), np.uint8)).astype(np.uint32)
    n = len(b) - 4
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])])[:-1]
    blank = b == 32
    out, h = np.empty((n, 3), np.int32), b[:n] * _MULT[0]
    inner = np.zeros(n, bool)
    for k in (1, 2, 3):
        h = (h ^ (h >> np.uint32(15))) + b[k : n + k] * _MULT[k]
        bad = blank[:n] & blank[1 : n + 1] if k == 1 else inner
        spread = h * _MULT[0]
        out[:, k - 1] = np.where(bad, 1 << bits, spread >> np.uint32(32 - bits))
        if k == 3:
            four = np.where(bad, np.int32(-1), (spread >> np.uint32(32 - WIDE)).astype(np.int32))
        inner = inner | blank[k : n + k]
    return out, at, four


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits by bucket; the last row, for no n-gram, is 0
    bias: np.ndarray
    heat: float
    threshold: float
    bits: int
    met: np.ndarray  # whether training met an n-gram of four bytes
    usual: float = 0.0  # share of n-grams not met in texts that training didn't see
    curve: tuple[float, float] = (0.0, 0.0)
    lean: float = 12.0

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and the share of n-grams that training didn't meet, of each text."""
        ids, at, four = subwords(texts, self.bits)
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(3):
            total += np.add.reduceat(self.table[ids[:, k]], at, axis=0, dtype=np.float64)
        count = np.add.reduceat((ids < 1 << self.bits).sum(1), at)
        own = four >= 0
        n, new = np.add.reduceat(own, at, dtype=np.int64), np.add.reduceat(own & ~self.met[four], at, dtype=np.int64)
        return total / np.maximum(count, 1)[:, None] + self.bias, (new + self.lean * self.usual) / (n + self.lean)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest language and its score: the softmax's times the chance that the text is in a learned language."""
        z, new = self.read(texts)
        p = softmax(z * self.heat)
        a, c = self.curve
        return p.argmax(1), p.max(1) / (1 + np.exp(np.clip(a * (new - c), -50, 50)))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and calibrated score of each text."""
        lang, score = [UND] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if self.langs and _LETTER.search(t)]
        if own:
            best, score[own] = self.scores([texts[i] for i in own])
            for i, k in zip(own, best, strict=True):
                lang[i] = self.langs[k]
        return lang, score


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _pieces(text: str, s: Settings, rng: np.random.Generator) -> list[str]:
    """Runs of words of several lengths from random places of the text, so that short texts are learnt too."""
    words = text.split()
    out = []
    for _ in range(s.pieces):
        n = s.words[rng.integers(len(s.words))]
        a = int(rng.integers(max(1, len(words) - n + 1)))
        out.append(" ".join(words[a : a + n]))
    return out


def train(rows: list[tuple[str, str]], s: Settings = Settings()) -> Model:
    """A model from (text, language) rows; the same rows in any order give the same model."""
    rows = sorted((t, x) for t, x in rows if t and x and _LETTER.search(t))
    langs = sorted({x for _, x in rows})
    empty = np.zeros(((1 << s.bits) + 1, len(langs)), np.float32)
    if not langs:
        return Model([], empty, np.zeros(0), 1.0, 1.0, s.bits, np.zeros(1 << WIDE, bool))
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(rows))
    cut = int(len(rows) * s.held_out)
    held, own = [rows[i] for i in order[:cut]], [rows[i] for i in order[cut:]]
    pieces = [(p, langs.index(x)) for t, x in own for p in _pieces(t, s, rng) if p]
    y = np.array([x for _, x in pieces])
    ids, at, _ = subwords([p for p, _ in pieces], s.bits)
    ends = np.append(at[1:], len(ids))
    seen = np.bincount(y, minlength=len(langs))
    weight = (len(y) / np.maximum(seen, 1) / len(langs)).clip(0.2, 5)
    emb = rng.normal(0, 0.1, ((1 << s.bits) + 1, s.dim)).astype(np.float32)
    emb[-1] = 0
    lin, bias = rng.normal(0, 0.3, (s.dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, step = s.epochs * -(-len(y) // 64), 0
    for _ in range(s.epochs):
        for batch in np.array_split(rng.permutation(len(y)), -(-len(y) // 64)):
            rate = s.rate * (1 - step / steps)
            step += 1
            flat = [ids[at[i] : ends[i]].ravel() for i in batch]
            flat = [x[x < 1 << s.bits] for x in flat]
            n = np.array([len(x) for x in flat])
            if not (n > 0).all():
                batch, flat = batch[n > 0], [x for x in flat if len(x)]
                n = n[n > 0]
                if not len(n):
                    continue
            k = np.concatenate(flat)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            h = np.add.reduceat(emb[k], starts, axis=0) / n[:, None]
            g = softmax(h @ lin + bias)
            g[np.arange(len(n)), y[batch]] -= 1
            g *= weight[y[batch]][:, None] / len(n)
            back = (g @ lin.T) / n[:, None]
            lin -= rate * 0.05 * (h.T @ g)
            bias -= rate * 0.05 * g.sum(0)
            np.add.at(emb, k, (-rate * np.repeat(back, n, axis=0)).astype(np.float32))
    met = np.zeros(1 << WIDE, bool)
    for k in range(0, len(own), 64):
        four = subwords([t for t, _ in own[k : k + 64]], s.bits)[2]
        met[four[four >= 0]] = True
    model = Model(langs, np.einsum("bd,dk->bk", emb, lin), bias.astype(np.float64), 1.0, 0.0, s.bits, met, lean=s.lean)
    if held:
        _calibrate(model, held, s, rng)
    return model


def _calibrate(model: Model, held: list[tuple[str, str]], s: Settings, rng: np.random.Generator) -> None:
    """Temperature, curve and threshold from texts that training doesn't see."""
    texts = [t for t, _ in held]
    z, new = zip(*(model.read(texts[i : i + 64]) for i in range(0, len(texts), 64)), strict=True)
    z, x = np.concatenate(z), np.array([model.langs.index(x) for _, x in held])
    loss = lambda h: -np.log(softmax(z * h)[np.arange(len(x)), x] + 1e-12).mean()
    model.heat = float(min(np.geomspace(0.05, 20, 61), key=loss))
    model.usual = float(np.median(np.concatenate(new)))
    own = [p for t in texts for p in _pieces(t, s, rng) if _LETTER.search(p)]
    other = [p for p in background(own, model.langs, rng) if _LETTER.search(p)]
    u, v = model.read(own)[1], model.read(other)[1]
    # The curve's middle lies halfway between nearly all of the one kind and nearly all of the other; where those overlap, where it tells them apart best.
    low, high = float(np.quantile(u, 0.999)), float(np.quantile(v, 0.02))
    if low < high:
        model.curve = (8 / (high - low), (low + high) / 2)
    else:
        curve_loss = lambda a, c: np.logaddexp(0, a * (u - c)).mean() + np.logaddexp(0, -a * (v - c)).mean()
        model.curve = min(((float(a), float(c)) for a in np.geomspace(5, 100, 14) for c in np.linspace(0.02, 0.9, 45)), key=lambda ac: curve_loss(*ac))
    score = np.concatenate([model.scores(texts[i : i + 64])[1] for i in range(0, len(texts), 64)])
    model.threshold = float(min(s.sure, np.quantile(score, s.lost)))


def held_out(doc_id: Column) -> Column:
    """Whether no model may learn from the document: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Trains on labelled documents that aren't held out; about equally many of each language, by a hash of id and text length."""
    own = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(s.most_langs).collect()
    each = max(s.least_rows, s.sample_rows // max(len(counts), 1))
    if not counts:
        return train([], s)
    parts = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, each / r["n"]) * (1 << 20)))])
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.length("text"), F.lit(s.seed)), F.lit(1 << 20))
    rows = own.where(part < F.coalesce(F.element_at(parts, F.col("lang")), F.lit(0))).select("text", "lang").collect()
    return train([tuple(r) for r in rows], s)


def _apply(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in by_rows(batches, text_sizes(), 1 << 19):  # a text takes some sixty times its bytes while it is read
        lang, score = model.predict(texts_of(b))
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(np.array([x != UND for x in lang], bool) & (score >= model.threshold))],
            names=[*b.schema.names, "lang_pred", "score", "accepted"],
        )


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with `lang_pred`, `score` and `accepted`; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score", "accepted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lambda it: _apply(it, shared.value), f"{fields}, lang_pred string, score double, accepted boolean")


def predict(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document, by a model fitted to the others' labels."""
    found = identify(docs.select("doc_id", "text"), fit(docs, s))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
