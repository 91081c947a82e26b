"""Secret scans: candidates by pattern, false positives removed by a random forest, all in DataFrame functions.

1. `CANDIDATE` finds tokens that may be secrets: known key formats, passwords in URLs, values assigned to secret-like names, and long
   tokens with digits or with three changes to capitals. One pass over a text puts marks around them; all else reads the parts between the marks.
2. Features: length, shares and changes of character classes, the share of letter pairs that words have, entropy, the part covered by
   dictionary words, path marks, neighbouring words, words of placeholders, assignment, and known formats.
3. A random forest, trained on the driver with numpy on `labelled()` findings (a bounded table made by rule, its features by
   the same DataFrame functions), becomes one expression of nested conditions. So the scan has no Python. What has a
   known format in full is a secret whatever the forest votes.

`find` gives a row for each confirmed secret; `redact` replaces them in the text. Both work row by row, without a shuffle.

Defined cases: null and empty texts have no findings and stay as they are; whole texts are searched; equal
rows give equal rows; a null id stays null; extra columns are ignored by `find` and kept by `redact`; an empty table
gives an empty table.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published formats of keys.
FORMATS = (
    ("aws-access-key", r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    ("gitlab-token", r"glpat-[A-Za-z0-9_-]{20}"),
    ("slack-token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe-key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    ("google-key", r"AIza[A-Za-z0-9_-]{35}"),
    ("npm-token", r"npm_[A-Za-z0-9]{36}"),
    ("pypi-token", r"pypi-[A-Za-z0-9_-]{50,}"),
    ("sendgrid-key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("private-key", r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----(?:(?:[^-]++|-(?!----))*+-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?"),
)
#: The part of a URL that names a user and a password, up to the sign before the host; without that sign a number is a port.
URL = r"(?i:[a-z][a-z0-9+.-]{1,20})://[^\s:/@\"']*:[^\s/@\"']+"
#: Words beside secrets, words beside harmless identifiers, and a small dictionary.
SECRET_WORDS = "password passwd pwd passphrase secret token apikey api_key api-key access_key auth authorization bearer credential credentials private_key client_secret"
PLAIN_WORDS = "commit sha sha1 sha256 md5 checksum digest revision rev hash uuid guid etag build version id isbn order invoice serial tracking integrity blob tree file path url image"
WORDS = (
    "about account address after example test sample data value name user users admin index table column file files path home local config default image images static "
    "assets style script module package class function return string number object method public private report project master branch feature release version update "
    "document documents article section chapter header footer content title page pages link street road house water light night world people company service system "
    "network server client client request response error message event handler manager factory builder reader writer parser loader helper common utils tools library "
    "this that with from have will your which their would there other these first could where after before great because through should"
)

#: Words that stand in for a value, or that fetch it from elsewhere.
PLACEHOLDERS = "your yours my the enter please example sample placeholder changeme change dummy fake none null todo xxx xxxx env environ getenv config settings get set read load required optional missing invalid disabled enabled"


def _either(words: list[str]) -> str:
    """A pattern for any of the words, with common beginnings written once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    if "" in heads and len(heads) == 1:
        return ""
    parts = [(f"[{h}]" if h == "-" else h) + _either(t) for h, t in heads.items() if h]
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in heads else "") if len(parts) > 1 or "" in heads else parts[0]


_END = r"(?![A-Za-z0-9_+/-])"
_BEGIN = r"(?<![A-Za-z0-9_+/-])"
#: A name and the sign of its value. What its first letter may be, and that no token but a URL's or a key's frame is shorter than 16, spares most of the work.
_NAMED = rf"(?=[{''.join(sorted({c for w in SECRET_WORDS.split() for c in w[0] + w[0].upper()}))}])(?i:{_either(SECRET_WORDS.split())})[\"']?\s{{0,40}}+(?:[:=]|is(?=\s)):?\s{{0,40}}+"
#: Groups 1, 2, 4 and 6 stand before a candidate, 3, 5, 7 and 8 are candidates. A named value in quotes goes up to the closing one, else up to a
#: blank, a quote that ends something, or the next field of a query.
CANDIDATE = (
    rf"({_NAMED})(?:"
    + "|".join(rf"({x})(?![^{x}\\\n]{{0,7}}{x})((?:[^{x}\\\n]++|\\[^\n])++)(?={x})" for x in "\"'")
    + r"|([\"']?)(?![\s\"'=:])((?:[^\s\"'&]|[\"'](?=[A-Za-z0-9])|&(?![A-Za-z_]+=)){8,}+))"
    + rf"|{_BEGIN}(?=[A-Za-z0-9_+/.-]{{16}}|-----B|[A-Za-z][A-Za-z0-9+.-]{{1,20}}+:)((?:" + "|".join(p for _, p in FORMATS) + rf"){_END}|{URL}(?=@)"
    + r"|(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}|(?=(?:[a-z_+/-]*+[A-Z]++){3})[A-Za-z_+/-]{20,}+={0,2})"
)
#: Marks around candidates: a sign that no text should hold, and one more; in texts that hold it another one follows it.
_SIGN, _KEPT, _MARK = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"
BLOCK = 256  # lengths are summed up by blocks, so that places of many candidates are not a square of work
MASK = "[SECRET]"
#: Letter pairs that the dictionary's words have twice or more.
PAIRS = tuple(sorted(p for p, n in Counter(w[i : i + 2] for w in set(WORDS.split()) for i in range(len(w) - 1)).items() if n > 1))


@dataclass(frozen=True)
class Settings:
    labelled: int = 2400
    trees: int = 15
    depth: int = 6
    seed: int = 3
    least: float = 0.5


def _features(token: Column, left: Column, right: Column) -> dict[str, Column]:
    n = F.length(token)
    share = lambda p: F.regexp_count(token, F.lit(p)) / n
    near = F.lower(F.right(F.regexp_replace(left, r"\s+", " "), F.lit(32)))
    has = lambda words: F.regexp_count(near, F.lit(r"(?<![a-z0-9])(?:" + words.replace(" ", "|") + r")(?![a-z0-9])")).cast("double")
    chars = F.split(token, "")
    counts = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n)
    known = F.lit(0.0)
    for _, p in FORMATS:
        known = F.when(token.rlike(f"^(?:{p})$"), 1.0).otherwise(known)
    known = F.when(token.rlike(f"^{URL}$") & right.startswith("@"), 1.0).otherwise(known)
    word = lambda words: F.regexp_count(F.lower(token), F.lit(r"(?<![a-z])(?:" + words.replace(" ", "|") + r")(?![a-z])")).cast("double")
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "hex": share("[0-9a-f]"),
        "changes": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "pairs": F.regexp_count(F.lower(token), F.lit(f"(?=(?:{'|'.join(PAIRS)}))[a-z]")) / F.greatest(F.regexp_count(token, F.lit("[A-Za-z](?=[A-Za-z])")), F.lit(1)),
        "entropy": F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "covered": 1 - F.length(F.regexp_replace(token, F.lit("(?i)" + "|".join(sorted(set(WORDS.split()), key=lambda w: (-len(w), w)))), F.lit(""))) / n,
        "path": F.regexp_count(token, F.lit("/")).cast("double") + F.when(left.rlike(r"[/.\\]$|https?:\S*$"), 2.0).otherwise(0.0) + F.when(right.rlike(r"^\.[a-z]{2,4}\b|^/"), 1.0).otherwise(0.0),
        "calls": F.regexp_count(token, F.lit(r"[(\[{<$]")).cast("double"),
        "placeholders": word(PLACEHOLDERS),
        "secret_words": has(SECRET_WORDS),
        "plain_words": has(PLAIN_WORDS),
        "assigned": F.when(left.rlike(r"(?:[:=]|\bis)\s{0,40}[\"']?$"), 1.0).otherwise(0.0),
        "format": known,
    }


FEATURES = ("length", "digits", "uppers", "lowers", "hex", "changes", "pairs", "entropy", "covered", "path", "calls", "placeholders", "secret_words", "plain_words", "assigned", "format")


def _parts(text: Column) -> Column:
    """A text in parts, every second one a candidate: the one pass of the pattern."""
    marked = F.regexp_replace(F.replace(text, F.lit(_SIGN), F.lit(_KEPT)), F.lit(CANDIDATE), F.lit(f"$1$2$4$6{_MARK}$3$5$7$8{_MARK}"))
    return F.transform(F.split(marked, _MARK, -1), lambda x: F.replace(x, F.lit(_KEPT), F.lit(_SIGN)))


def _zipped(parts: Column) -> Column:
    """(token, left, right) of each candidate."""
    rest, tokens = F.filter(parts, lambda _, i: i % 2 == 0), F.filter(parts, lambda _, i: i % 2 == 1)
    zipped = F.arrays_zip(tokens.alias("token"), rest.alias("left"), F.slice(rest, F.lit(2), F.lit(1 << 30)).alias("right"))
    return F.filter(zipped, lambda x: x["token"].isNotNull())


def _near(x: Column) -> dict[str, Column]:
    return _features(x["token"], F.right(x["left"], F.lit(64)), F.left(x["right"], F.lit(16)))


def _scored(parts: Column, score) -> Column:
    """Array of (token, score) of the candidates in order, each one's features computed once."""
    made = F.transform(_zipped(parts), lambda x: F.struct(x["token"].alias("token"), *[v.cast("double").alias(k) for k, v in _near(x).items()]))
    return F.transform(made, lambda x: F.struct(x["token"].alias("token"), score(x).alias("score")))


# Training on the driver ------------------------------------------------------------------------------------------------


def labelled(n: int, seed: int) -> list[tuple[str, bool]]:
    """n findings as (text with one candidate, whether it is a secret), made by rule from the published formats and from
    the look of harmless tokens: hashes beside plain words, paths, numbers, names, identifiers, calls, placeholders."""
    rng = random.Random(seed)
    words = WORDS.split()
    pick = lambda signs, k: "".join(rng.choices(signs, k=k))
    low, up, num, hexa = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
    alnum = low + up + num
    vowels, others = "aeiou", "bcdfghklmnprstvw"
    spoken = lambda: "".join(rng.choice(others) + rng.choice(vowels) for _ in range(rng.randint(2, 4)))  # a word that no dictionary has
    any_word = lambda: rng.choice(words) if rng.random() < 0.6 else spoken()
    talk = lambda k: " ".join(any_word() for _ in range(k))
    name = lambda: rng.choice([w for w in SECRET_WORDS.split() if w not in ("bearer", "authorization")])
    locked = lambda: rng.choice(["password", "passwd", "pwd", "passphrase", "secret"])
    plain = lambda: rng.choice(PLAIN_WORDS.split())
    glue = lambda: rng.choice(["=", " = ", ": ", ":", '="', ' = "', ": '"])
    hinted = lambda: rng.choice("your my the enter example change dummy please".split())
    yes = [
        lambda: "AKIA" + pick(up + num, 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(num, 12) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum, 35),
        lambda: name() + glue() + pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64])),
        lambda: name() + glue() + pick(alnum, rng.randint(10, 48)),
        lambda: name() + glue() + pick(alnum + "!#$%*", rng.randint(8, 20)),
        lambda: "authorization: bearer " + pick(alnum, rng.randint(20, 60)),
        lambda: pick(alnum + "+/", rng.randint(36, 48)) + "=",
        lambda: pick(alnum, rng.randint(32, 44)),
        lambda: locked() + rng.choice(["=", ": ", " is "]) + "-".join(any_word() for _ in range(rng.randint(3, 5))),
        lambda: locked() + rng.choice(["=", ": ", " is "]) + any_word() + pick(num, rng.randint(1, 4)) + rng.choice(["", "!", any_word(), any_word() + pick(num, 2)]),
        lambda: locked() + glue() + spoken().title() + pick(num, rng.randint(2, 4)) + rng.choice("!?#*"),
    ]
    no = [
        lambda: plain() + glue() + pick(hexa, rng.choice([16, 20, 32, 40, 64])),
        lambda: plain() + " " + pick(hexa, rng.choice([32, 40, 64])),
        lambda: plain() + rng.choice([" ", "=", ": "]) + rng.choice(["sha1-", "sha256-", "sha384-", "sha512-"]) + pick(alnum + "+/", rng.randint(27, 60)),
        lambda: name() + rng.choice(["=", " = ", ": "]) + rng.choice(["os.environ[", "getenv(", "config.get("]) + "'" + any_word().upper() + "_" + name().upper(),
        lambda: talk(1) + " " + pick(num, rng.randint(16, 24)),
        lambda: "/".join(any_word() for _ in range(4)) + "/" + any_word() + str(rng.randint(1, 99)),
        lambda: "https://www.example.com/" + any_word() + "-" + any_word() + "-" + pick(num, 6),
        lambda: "-".join(any_word() for _ in range(rng.randint(3, 6))) + "-" + pick(num, rng.randint(1, 4)),
        lambda: "_".join(any_word() for _ in range(rng.randint(3, 6))) + pick(num, rng.randint(1, 3)),
        lambda: "".join(any_word().title() for _ in range(rng.randint(3, 6))) + rng.choice(["", pick(num, rng.randint(1, 2))]),
        lambda: any_word() + "".join(any_word().title() for _ in range(rng.randint(3, 5))),
        lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-4{pick(hexa, 3)}-a{pick(hexa, 3)}-{pick(hexa, 12)}",
        lambda: name() + glue() + hinted() + rng.choice("_-") + rng.choice("_-").join([any_word(), rng.choice(SECRET_WORDS.split())]),
        lambda: name() + glue() + any_word() + any_word(),
        lambda: name() + rng.choice([" is ", ": "]) + rng.choice("required optional missing invalid disabled rejected generated expired".split()),
        lambda: name() + glue() + rng.choice(["os.environ[", "config.get(", "settings.", "read_file(", "${", "<", "getenv("]) + any_word() + "_" + any_word() + rng.choice(["", ")", "]", "}", ">"]),
        lambda: "2024-0" + pick("123456789", 1) + "-1" + pick(num, 1) + "T10-2" + pick(num, 1) + "-00-build",
    ]
    out = []
    while len(out) < n:
        good = len(out) % 2 == 0
        text = rng.choice(yes if good else no)()
        end = '"' if text.count('"') % 2 else "'" if text.count("'") % 2 else ""
        out.append((f"{talk(rng.randint(1, 4))} {text}{end} {talk(rng.randint(1, 3))}", good))
    return out


def grow(x: np.ndarray, y: np.ndarray, s: Settings) -> list:
    """A random forest; a tree is a part of secrets, or (feature, threshold, tree at or below, tree above)."""
    rng = np.random.default_rng(s.seed)
    tried = max(2, int(np.sqrt(x.shape[1]) + 1))

    def node(rows: np.ndarray, depth: int):
        part = float(y[rows].mean())
        if depth == 0 or part in (0.0, 1.0) or len(rows) < 4:
            return part
        best = None
        for f in rng.permutation(x.shape[1])[:tried]:
            values = np.unique(np.quantile(x[rows, f], np.linspace(0.05, 0.95, 19)))
            for v in (values[:-1] + values[1:]) / 2:
                low = x[rows, f] <= v
                a, b = int(low.sum()), int((~low).sum())
                if a and b:
                    p, q = y[rows][low].mean(), y[rows][~low].mean()
                    cost = a * p * (1 - p) + b * q * (1 - q)
                    if best is None or cost < best[0]:
                        best = (cost, int(f), float(v), low)
        if best is None:
            return part
        _, f, v, low = best
        return (f, v, node(rows[low], depth - 1), node(rows[~low], depth - 1))

    return [node(rng.integers(len(x), size=len(x)), s.depth) for _ in range(s.trees)]


def vote(forest: list, row: list[float]) -> float:
    total = 0.0
    for t in forest:
        while isinstance(t, tuple):
            t = t[2] if row[t[0]] <= t[1] else t[3]
        total += t
    return total / len(forest)


def expression(forest: list, features: list[Column]) -> Column:
    """The forest's vote as one expression."""

    def of(t) -> Column:
        return F.when(features[t[0]] <= t[1], of(t[2])).otherwise(of(t[3])) if isinstance(t, tuple) else F.lit(t)

    return sum((of(t) for t in forest), F.lit(0.0)) / len(forest)


def fit(spark: SparkSession, s: Settings = Settings()) -> list:
    """Trains on labelled findings; their features come from the same functions as the scan's."""
    rows = labelled(s.labelled, s.seed)
    df = spark.createDataFrame(pa.table({"text": [t for t, _ in rows], "y": [float(y) for _, y in rows]}))
    made = df.select(_parts(F.col("text")).alias("parts"), "y").select(F.get(_zipped(F.col("parts")), F.lit(0)).alias("x"), "y").where("x is not null")
    made = made.select(*[v.cast("double").alias(k) for k, v in _near(F.col("x")).items()], "y")
    data = np.array([tuple(r) for r in made.collect()])
    return grow(data[:, :-1], data[:, -1], s)


def scanned(spark: SparkSession, s: Settings = Settings(), forest: list | None = None) -> Column:
    """Array of (token, score) from the column `parts`."""
    forest = forest or fit(spark, s)
    vote_ = lambda x: expression(forest, [x[k] for k in FEATURES])
    return _scored(F.col("parts"), lambda x: F.when(x["format"] == 1, F.greatest(vote_(x), F.lit(s.least))).otherwise(vote_(x)))


def _kind(token: Column) -> Column:
    out = F.when(token.rlike(f"^{URL}$"), "url-password").otherwise("assigned-or-random")
    for name, p in reversed(FORMATS):
        out = F.when(token.rlike(f"^(?:{p})$"), name).otherwise(out)
    return out


def find(docs: DataFrame, s: Settings = Settings(), forest: list | None = None) -> DataFrame:
    """A row for each secret: doc_id, its place in the text (code points from 0), length, kind, score, and the token with its middle masked."""
    # Each column is made once from the one before; an outer explode lets no filter on what it reads be derived, which would run the pattern again.
    own = docs.select("doc_id", _parts(F.col("text")).alias("parts"))
    own = own.select("doc_id", "parts", F.transform("parts", lambda p: F.length(p)).alias("lengths"), scanned(docs.sparkSession, s, forest).alias("found"))
    add = lambda a, x: a + x
    total = lambda lengths: F.aggregate(lengths, F.lit(0), add)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("lengths") / BLOCK).cast("int")), lambda b: total(F.slice("lengths", b * BLOCK + 1, F.lit(BLOCK))))
    own = own.select("doc_id", "lengths", "found", F.when(F.size("lengths") > 1, blocks).alias("blocks"))

    def placed(x: Column, i: Column) -> Column:
        at = 2 * i + 1  # the candidate's place among the parts
        block = F.floor(at / BLOCK).cast("int")
        before = total(F.slice("blocks", F.lit(1), block)) + total(F.slice("lengths", block * BLOCK + 1, at - block * BLOCK))
        return F.struct(x["token"].alias("token"), x["score"].alias("score"), before.alias("start"))

    secrets = F.filter(F.transform("found", placed), lambda x: x["score"] >= s.least)
    rows = own.select("doc_id", F.explode_outer(secrets).alias("one")).where("one is not null")
    token = F.col("one.token")
    return rows.select(
        "doc_id", F.col("one.start").cast("long").alias("start"), F.length(token).cast("long").alias("length"), _kind(token).alias("kind"), F.round("one.score", 6).alias("score"),
        F.concat(F.left(token, F.lit(4)), F.lit("***"), F.right(token, F.lit(2))).alias("redacted"), F.sha2(token, 256).alias("secret_sha256"),
    )


def redact(docs: DataFrame, s: Settings = Settings(), forest: list | None = None) -> DataFrame:
    """The documents with a mask for each secret, and n_chars, where there is such a column, as it then is."""
    names = docs.columns
    own = docs.select("*", _parts(F.col("text")).alias("_parts"))
    parts = own.select("*", F.col("_parts").alias("parts")) if "parts" not in names else own.withColumnRenamed("parts", "_own_parts").withColumn("parts", F.col("_parts"))
    found = parts.withColumn("_found", scanned(docs.sparkSession, s, forest))
    masked = F.transform("_parts", lambda p, i: F.when((i % 2 == 1) & (F.get(F.col("_found"), F.floor(i / 2).cast("int"))["score"] >= s.least), F.lit(MASK)).otherwise(p))
    out = found.withColumn("text", F.array_join(masked, ""))
    out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
    out = out.drop("parts").withColumnRenamed("_own_parts", "parts") if "parts" in names else out
    return out.select(names)
