"""Pseudonyms of every kind: found, of the same format, linked across documents, restored with the key, and nothing else touched."""

import re

import pytest

from sievelight.llm import pii

S = pii.Settings(key=b"a key of the test")
VALUES = {
    "email": ["ann.lee+x@mail.example.com", "Bob_9@example.org"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "card": ["4111 1111 1111 1111", "5500005555555559", "3400-000000-00009"],
    "phone": ["+1 (227) 555-6608", "(415) 555-2671", "415-555-2671", "415.555.2671", "555 223 4567", "020 7946 0958", "0171/1234567", "+49 30 1234 5678"],
    "ipv4": ["10.0.0.255", "192.168.1.7"],
    "ipv6": ["2001:db8:85a3::8a2e:370:7334", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a"],
    "date": ["2020-02-29", "12/31/1999", "31.12.1999", "1/2/2020", "3.4.2021", "12 March 1980", "March 5, 2001", "05 May 2011", "3. Oktober 1990", "7 de marzo de 2015", "14 juillet 1989", "2 Feb 2010"],
    "ssn": ["219-09-9999"],
}
SAID = ["call 5552234567 now", "Tel: 02079460958", "phone 4155552671"]
#: What looks like a value and is none, or isn't one for sure.
OTHERS = [
    "4984250489669608", "999.1.1.1", "2024-02-31", "31/31/2020", "000-12-3456", "5552234567", "12345678901", "12:30:45", "abc::def", "100 200 3000", "155 123 4567", "version 1.2.3", "31 February 2010", "40 March 2010", "May 2011",
    "March of 1999 men", "a@b", "DE00370400440532013000", "3.14159", "1/2/20", "room 020 7", "::", "10.1.2020.5", "2001:DB8::1G",
]


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_every_kind(kind, value):
    text = f"a {value}, then {value} b"
    new, found = pii.replace(text, S)
    assert [k for k, _, _ in found] == [kind] * 2 and [text[a : a + n] for _, a, n in found] == [value] * 2
    own = new[2 : new.index(", then ")] if kind != "date" or "," not in value else new[2 : new.rindex(", then ")]
    assert own != value and new == f"a {own}, then {own} b" and pii.restore(new, S) == text
    if kind not in ("ipv4", "ipv6", "date"):
        assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", own))) == re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", value)))
    assert pii.replace(text, pii.Settings(b"another"))[0] != new


@pytest.mark.parametrize("text", SAID)
def test_numbers_that_a_word_announces(text):
    new, found = pii.replace(text, S)
    assert [k for k, _, _ in found] == ["phone"] and new != text and re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text) and pii.restore(new, S) == text


@pytest.mark.parametrize("text", OTHERS)
def test_left_alone(text):
    assert pii.replace(f"x {text} y", S) == (f"x {text} y", [])


def test_days_are_permuted_one_to_one():
    """Every written day of some years has a pseudonym of its own, which leads back to it."""
    days = [f"{d} {m} {y}" for y in (1999, 2000) for m in pii.MONTHS["de"].split() for d in range(1, 29)]
    got = [pii.replace(x, S)[0] for x in days]
    assert len(set(got)) == len(days) and [pii.restore(x, S) for x in got] == days


def test_key(spark):
    """The session's key is used; without one values are linked within the session and differ from any fixed key's."""
    df = spark.createDataFrame([(1, "mail ann.lee@example.com"), (2, "to ann.lee@example.com"), (None, None), (1, "mail ann.lee@example.com"), (3, "x " * 100_000 + "10.0.0.255")], "doc_id long, text string")
    texts = lambda: sorted((r.doc_id or 0, r.text or "", r.n_replaced) for r in pii.pseudonymised(df).collect())
    first, again = texts(), texts()
    assert first == again and first[1][1].split()[1] == first[3][1].split()[1] != "ann.lee@example.com" and [n for _, _, n in first] == [0, 1, 1, 1, 1]
    spark.conf.set(pii.KEY, "a key of the test")
    try:
        assert texts()[1][1] == pii.replace("mail ann.lee@example.com", S)[0]
    finally:
        spark.conf.unset(pii.KEY)


def test_a_date_is_one_date_in_every_notation():
    """1000 dates in eight notations: equal dates get equal pseudonyms, different ones different ones, and all come back."""
    import datetime as dt
    import random

    rng = random.Random(4)
    months = {k: v.split() for k, v in pii.MONTHS.items()}
    seen = {}
    for n in rng.sample(range(dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal()), 1000):
        day = dt.date.fromordinal(n)
        write = [
            lambda x: f"{x:%Y-%m-%d}", lambda x: f"{x:%d.%m.%Y}", lambda x: f"{x.day}.{x.month}.{x.year}", lambda x: f"{x:%m/%d/%Y}", lambda x: f"{x.month}/{x.day}/{x.year}", lambda x: f"{x.day} {months['en'][x.month - 1]} {x.year}",
            lambda x: f"{x.day}. {months['de'][x.month - 1]} {x.year}", lambda x: f"{months['en short'][x.month - 1]} {x.day}, {x.year}", lambda x: f"{x.day} {months['fr'][x.month - 1]} {x.year}", lambda x: f"{x.day} de {months['es'][x.month - 1]} de {x.year}",
        ]
        text = " then ".join(f"on {w(day)}" for w in write)
        new, found = pii.replace(text, S)
        assert [k for k, _, _ in found] == ["date"] * len(write) and pii.restore(new, S) == text
        other = dt.date.fromisoformat(new[3:13])
        assert new == " then ".join(f"on {w(other)}" for w in write)
        seen[other] = day
    assert len(seen) == 1000 and sum(a != b for a, b in seen.items()) > 990


@pytest.mark.parametrize("one, other", [("+44 (0)20 7946 0958", "+44 20 7946 0958"), ("+49 (0)30 1234 5678", "+49-30-1234-5678"), ("+353 1 234 5678", "+353 (0)1 234 5678")])
def test_a_trunk_zero_stays(one, other):
    new = [pii.replace(f"at {x}", S)[0] for x in (one, other)]
    digits = [re.sub(r"\D", "", x.replace("(0)", "")) for x in new]
    code = re.match(r"\+\d+", one)[0]
    assert digits[0] == digits[1] and all(x.startswith(f"at {code}") for x in new) and "(0)" in new[0] + new[1]
    assert [pii.restore(x, S) for x in new] == [f"at {one}", f"at {other}"] and new[0] != f"at {one}"
