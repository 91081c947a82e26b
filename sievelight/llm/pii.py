"""PII: format-preserving pseudonyms of validated values, by a keyed Feistel network.

Patterns find candidates; each kind has its own validation (card numbers by Luhn's sum, IBANs modulo 97, octets up
to 255, IPv6 addresses by the standard library, calendar dates in digits or with a month's name, telephone and social security numbers by their numbering plans, mail
addresses by their shape; ten digits in one run are a telephone number only after a word that says so). A
valid value's free symbols (digits, or letters and digits, each with its own radix) are permuted: two halves take turns to be
shifted by a keyed hash of the other, so the map is one to one, and the same key maps equal values to equal
pseudonyms in every document, however they are separated or cased. A date's pseudonym is the same date in every notation. Where not every string of the format is valid, the permutation
is applied until the value is (cycle walking); check digits are computed anew. `restore` inverts it with the key.

The key is a secret of the job: `spark.sievelight.pii.key`, or `Settings.key`. Without either, one is drawn at random for the session, so values stay
linked within that session and nobody can restore them.

Defined cases: null and empty texts stay as they are; numbers that fail their validation stay; whole texts are read;
equal rows give equal rows; a null id stays null; `pseudonymise` keeps extra columns; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import calendar
import datetime as dt
import functools
import hashlib
import ipaddress
import re
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_rows, text_sizes, texts_of

KINDS = ("email", "iban", "card", "phone", "ipv4", "ipv6", "date", "ssn")


@dataclass(frozen=True)
class Settings:
    key: bytes
    rounds: int = 8


KEY = "spark.sievelight.pii.key"


@functools.cache
def _drawn(application: str) -> bytes:
    return secrets.token_bytes(32)


def settings(spark: SparkSession) -> Settings:
    """With the session's key, or one drawn at random where it has none."""
    key = spark.conf.get(KEY, None)
    return Settings(key.encode() if key else _drawn(spark.sparkContext.applicationId))


def _noise(key: bytes, kind: str, i: int, shape: tuple[int, ...], half: int) -> int:
    data = f"{kind}|{i}|{shape}|{half}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=24).digest(), "big")


def permuted(symbols: tuple[int, ...], radix: tuple[int, ...], kind: str, s: Settings, back: bool = False) -> tuple[int, ...]:
    """The keyed permutation of strings of symbols with these radices; `back` inverts it."""
    cut = len(radix) // 2
    size = [1, 1]
    value = [0, 0]
    for i, (x, r) in enumerate(zip(symbols, radix, strict=True)):
        k = int(i >= cut)
        size[k], value[k] = size[k] * r, value[k] * r + x
    for i in reversed(range(s.rounds)) if back else range(s.rounds):
        k = (i + 1) % 2
        shift = _noise(s.key, kind, i, radix, value[1 - k])
        value[k] = (value[k] - shift if back else value[k] + shift) % size[k]
    out = []
    for k, part in ((1, radix[cut:]), (0, radix[:cut])):
        for r in reversed(part):
            value[k], x = divmod(value[k], r)
            out.append(x)
    return tuple(reversed(out))


def walked(digits: str, kind: str, s: Settings, good: Callable[[str], bool], back: bool) -> str:
    """Permutes digits until `good` holds, as it does for the given ones."""
    radix = (10,) * len(digits)
    while True:
        digits = "".join(map(str, permuted(tuple(map(int, digits)), radix, kind, s, back)))
        if good(digits):
            return digits


def luhn(digits: str) -> int:
    """Luhn's sum modulo 10; 0 if the last digit is right."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(doubled[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _put(value: str, digits: str) -> str:
    """The value with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), value)


def _digits(value: str) -> str:
    return re.sub(r"\D", "", value)


def _email(value: str, s: Settings, back: bool) -> str | None:
    local, domain = value.rsplit("@", 1)
    free = [c for c in local.lower() if c.isascii() and c.isalnum()]
    if not free:
        return None
    radix = tuple(10 if c.isdigit() else 26 for c in free)
    codes = tuple(ord(c) - (48 if c.isdigit() else 97) for c in free)
    new = iter([chr(x + (48 if r == 10 else 97)) for x, r in zip(permuted(codes, radix, "email:" + domain.lower(), s, back), radix, strict=True)])
    return "".join((n.upper() if c.isupper() else n) if c.isascii() and c.isalnum() and (n := next(new)) else c for c in local) + "@" + domain


def _card(value: str, s: Settings, back: bool) -> str | None:
    d = _digits(value)
    if not 13 <= len(d) <= 19 or d[0] not in "3456" or luhn(d) or len(set(d)) == 1:
        return None
    body = walked(d[:-1], "card", s, lambda x: x[0] in "3456" and len(set(x)) > 1, back)
    return _put(value, body + str(-luhn(body + "0") % 10))


def _iban(value: str, s: Settings, back: bool) -> str | None:
    v = value.replace(" ", "")
    number = lambda x: int("".join(str(int(c, 36)) for c in x[4:] + x[:4]))
    if number(v) % 97 != 1 or not 15 <= len(v) <= 34:
        return None
    radix = tuple(10 if c.isdigit() else 26 for c in v[4:])
    codes = tuple(int(c) if c.isdigit() else ord(c) - 65 for c in v[4:])
    body = "".join(chr(x + (48 if r == 10 else 65)) for x, r in zip(permuted(codes, radix, "iban" + v[:2], s, back), radix, strict=True))
    new = iter(v[:2] + f"{98 - number(v[:2] + '00' + body) % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in value)


#: The countries' telephone codes of two digits (E.164); 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def _phone(value: str, s: Settings, back: bool) -> str | None:
    d = _digits(value)
    plan = re.fullmatch(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}", value)
    if d.startswith("1") and len(d) == 11:
        head, own = "1", d[1:]
    elif plan:
        head, own = "", d
    elif value.startswith("+") and 8 <= len(d) <= 15:
        # The country's code stays, as does a zero in brackets that callers from abroad leave out; so the number is the same with it and without it.
        code = d[: 1 if d[0] == "7" else 2 if d[:2] in TWO_DIGIT_CODES else 3]
        head = code + "0" * bool(re.match(rf"\+{code}[ .-]?\(0\)", value))
        own = d[len(head) :]
        if len(own) < 4:
            return None
        return _put(value, head + walked(own, "phone" + code, s, lambda x: (x[0] == "0") == (own[0] == "0"), back))
    elif value.startswith("0") and 9 <= len(d) <= 12 and d[1] != "0":
        # A national number keeps its zero and the digit after it, which says what kind of number it is.
        return _put(value, d[:2] + walked(d[2:], "phone0", s, lambda x: True, back))
    else:
        return None
    # Area codes begin with 2 to 9; numbers with another one are permuted among themselves. Digits between blanks count only with both codes right.
    low, strict = own[0] in "01", bool(plan) and value[3] in " 0123456789"
    if strict and (low or own[3] in "01"):
        return None
    return _put(value, head + walked(own, "phone1", s, lambda x: (x[0] in "01") == low and not (strict and x[3] in "01"), back))


def _ipv4(value: str, s: Settings, back: bool) -> str | None:
    octets = tuple(map(int, value.split(".")))
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
        return None
    return ".".join(map(str, permuted(octets, (256,) * 4, "ipv4", s, back)))


def _ipv6(value: str, s: Settings, back: bool) -> str | None:
    """The last 80 bits, behind the network's prefix, of an address in its full or its canonical form, which it keeps."""
    try:
        whole = ipaddress.IPv6Address(value)
    except ValueError:
        return None
    if value not in (str(whole), whole.exploded) or not any(c.isdigit() for c in value) or not any(whole.packed[6:]) or len(value) < 6:
        return None
    new = ipaddress.IPv6Address(whole.packed[:6] + bytes(permuted(tuple(whole.packed[6:]), (256,) * 10, "ipv6", s, back)))
    return new.exploded if value == whole.exploded else str(new)


@functools.cache
def _classes() -> dict[tuple, list[int]]:
    """The days from 1900 to 2099 in classes that every notation keeps apart: days up to 9, 10 to 12 (which could be months) and above, months of one
    and of two digits, and months whose names the same languages share. Within its class a date has one pseudonym in all notations."""
    out: dict[tuple, list[int]] = {}
    for n in range(dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal() + 1):
        out.setdefault(_class(dt.date.fromordinal(n)), []).append(n)
    return out


@functools.cache
def _shared(month: int) -> tuple[str, ...]:
    """For each language the first one that has its name of the month."""
    return tuple(next(k for k, v in _MONTHS.items() if names[month - 1] in v) for names in _MONTHS.values())


def _class(day: dt.date) -> tuple:
    return (day.day > 9) + (day.day > 12), day.month > 9, _shared(day.month)


def _day(day: dt.date, s: Settings, back: bool) -> dt.date:
    """The day's pseudonym: a place among the days of its class, permuted."""
    days = _classes()[_class(day)]
    x, radix = bisect.bisect_left(days, day.toordinal()), (-(-len(days) // 64), 64)
    while True:
        high, low = permuted(divmod(x, 64), radix, f"date{_class(day)}", s, back)
        x = high * 64 + low
        if x < len(days):
            return dt.date.fromordinal(days[x])


def _date(value: str, s: Settings, back: bool) -> str | None:
    parts = re.split(r"\D", value)
    numbers = [int(x) for x in parts]
    year_first = len(parts[0]) == 4
    day_first = not year_first and (numbers[0] > 12 or "." in value)
    y, m, d = numbers if year_first else (numbers[2], *(numbers[1::-1] if day_first else numbers[:2]))
    if not (1900 <= y <= 2099 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    new = _day(dt.date(y, m, d), s, back)
    out = (new.year, new.month, new.day) if year_first else ((new.day, new.month) if day_first else (new.month, new.day)) + (new.year,)
    # A number of one digit stays one in its class, and so do zeros before it.
    return re.search(r"\D", value)[0].join(f"{x:0{len(old)}d}" for x, old in zip(out, parts, strict=True))


#: Names of months, by language.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "en short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
}
_MONTHS = {k: [x.lower() for x in v.split()] for k, v in MONTHS.items()}


def _written(value: str, s: Settings, back: bool) -> str | None:
    """A date with a month's name: its pseudonym, which has a name of the same language and a day of as many digits."""
    name = re.search(r"[^\W\d_]{3,}", value)[0]
    held = [k for k, v in _MONTHS.items() if name.lower() in v]
    if not held:
        return None
    months = _MONTHS[held[0]]
    m = months.index(name.lower()) + 1
    d, y = (int(x) for x in re.findall(r"\d+", value))
    if not (1900 <= y <= 2099 and 1 <= d <= calendar.monthrange(y, m)[1]):
        return None
    two = len(re.search(r"\d+", value)[0]) == 2
    new = _day(dt.date(y, m, d), s, back)
    month = months[new.month - 1]
    month = month.upper() if name.isupper() else month.title() if name[0].isupper() else month
    out = value.replace(name, "\0", 1)
    out = re.sub(r"\d{4}", f"{new.year:04d}", out)
    out = re.sub(r"(?<!\d)\d{1,2}(?!\d)", f"{new.day:02d}" if two else str(new.day), out, count=1)
    return out.replace("\0", month)


def _ssn(value: str, s: Settings, back: bool) -> str | None:
    good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    d = _digits(value)
    return _put(value, walked(d, "ssn", s, good, back)) if good(d) else None


RULES = {"email": _email, "iban": _iban, "card": _card, "phone": _phone, "said": _phone, "ipv4": _ipv4, "ipv6": _ipv6, "date": _date, "written": _written, "ssn": _ssn}
#: Patterns that are one kind's with another look.
COUNTED = {"said": "phone", "written": "date"}
_NAMES = "|".join(sorted({x for v in MONTHS.values() for x in v.split()}, key=lambda x: (-len(x), x)))

PATTERN = re.compile(
    r"(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9]))"
    r"|(?<![A-Za-z0-9])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![\w.])(?P<ipv4>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\w]|\.\d)"
    r"|(?<![\w/.-])(?P<date>(?:19|20)\d\d-\d\d-\d\d|\d\d?/\d\d?/(?:19|20)\d\d|\d\d?\.\d\d?\.(?:19|20)\d\d)(?![\w/-]|\.\d)"
    r"|(?<![\w.:])(?P<ipv6>(?:[0-9A-Fa-f]{1,4}:){1,7}(?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?|[0-9A-Fa-f]{1,4}))(?![\w:])"
    rf"|(?<![\w.-])(?P<written>\d\d?(?:\.| de|st|nd|rd|th)? (?i:{_NAMES}) (?:de )?(?:19|20)\d\d|(?i:{_NAMES}) \d\d?,? (?:19|20)\d\d)(?![\w-])"
    r"|(?<![\w.-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\w-])"
    r"|(?<![\w.-])(?P<card>\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-])"
    r"|(?<![\w.-])(?P<phone>\+\d{1,3}[ .-]?(?:\(0\) ?\d{1,4}|\(?\d{1,4}\)?)(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}(?P<by>[ .-])\d{3}(?P=by)\d{4}|0\d{2,4}[ /-]\d{3,4} ?\d{3,5})(?![\w-])"
    r"|(?i:tel|phone|call|mobile|cell|fax|telefon|teléfono|téléphone|handy|móvil)[a-z]*[.:]? {0,3}(?P<said>\d{10}|0\d{10})(?![\w-])"
)
#: A text without any of these has nothing to find.
_SOME = re.compile(r"\d|@")


@functools.lru_cache(maxsize=1 << 14)
def _mapped(kind: str, value: str, s: Settings, back: bool) -> str | None:
    return RULES[kind](value, s, back)


def replace(text: str, s: Settings, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each in the original text."""
    if not _SOME.search(text):
        return text, []
    parts, found, at, look = [], [], 0, 0
    while m := PATTERN.search(text, look):
        kind = m.lastgroup
        value, start = m[kind], m.start(kind)
        new = _mapped(kind, value, s, back)
        if new is None and kind == "phone" and (short := re.match(r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)", value)):
            value = short[0]
            new = _mapped(kind, value, s, back)
        if new is None:
            look = start + 1
            while look < len(text) and text[look - 1].isalnum() and text[look].isalnum():
                look += 1  # no match begins within a word or a number
            continue
        parts += [text[at:start], new]
        found.append((COUNTED.get(kind, kind), start, len(value)))
        at = look = start + len(value)
    return "".join([*parts, text[at:]]), found


def restore(text: str, s: Settings) -> str:
    return replace(text, s, True)[0]


def _applied(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    for b in by_rows(batches, text_sizes(), 4 << 20):
        done = [replace(t, s) for t in texts_of(b)]
        null = b.column("text").is_null().to_pylist()
        counts = [{k: sum(x[0] == k for x in found) for k in KINDS} for _, found in done]
        made = {c: b.column(c) for c in b.schema.names} | {"text": pa.array([None if n else t for n, (t, _) in zip(null, done, strict=True)], pa.string())}
        made |= {f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in KINDS}
        yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def pseudonymise(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents with pseudonyms in `text`, and the numbers of values by kind as n_email and so on (replacing such columns)."""
    s = s or settings(docs.sparkSession)
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda it: _applied(it, s), fields + "".join(f", n_{k} long" for k in KINDS))


def pseudonymised(docs: DataFrame, s: Settings | None = None) -> DataFrame:
    """doc_id, text, n_replaced and the counts by kind of each document."""
    out = pseudonymise(docs.select("doc_id", "text"), s)
    return out.withColumn("n_replaced", sum((F.col(f"n_{k}") for k in KINDS), F.lit(0).cast("long")))
