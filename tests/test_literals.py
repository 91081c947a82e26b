"""Needed texts hold: texts made from every rule's pattern, at random, hold one of them, and the index gives back the rule."""

import random
import re
from re import _constants as K
from re import _parser

import pytest
from pyspark.sql import functions as F

from sievelight.operators import literals
from sievelight.operators.catalog import BUILT_IN, Catalog, Rule
from sievelight.operators.detect import rule_scan

PLAIN = "abcxyz019 _-.,()\"'"


def example(items, rng) -> str:
    """A text that the parsed pattern matches, but for what its anchors and needs around it ask."""
    out = []
    for op, value in items:
        if op is K.LITERAL:
            out.append(rng.choice([chr(value).lower(), chr(value).upper()]))
        elif op is K.NOT_LITERAL:
            out.append(rng.choice([c for c in PLAIN if c != chr(value)]))
        elif op is K.ANY:
            out.append(rng.choice(PLAIN))
        elif op is K.IN:
            pattern = re.compile("[" + "".join(members(value)) + "]")
            out.append(rng.choice([c for c in map(chr, range(32, 127)) if pattern.match(c)]))
        elif op is K.SUBPATTERN:
            out.append(example(value[-1], rng))
        elif op is K.BRANCH:
            out.append(example(rng.choice(value[1]), rng))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = value
            out += [example(inner, rng) for _ in range(rng.randint(low, min(high, low + 3)))]
    return "".join(out)


def members(value):
    for op, x in value:
        if op is K.NEGATE:
            yield "^"
        elif op is K.LITERAL:
            yield re.escape(chr(x))
        elif op is K.RANGE:
            yield f"{re.escape(chr(x[0]))}-{re.escape(chr(x[1]))}"
        else:
            yield {K.CATEGORY_DIGIT: r"\d", K.CATEGORY_NOT_DIGIT: r"\D", K.CATEGORY_SPACE: r"\s", K.CATEGORY_NOT_SPACE: r"\S", K.CATEGORY_WORD: r"\w", K.CATEGORY_NOT_WORD: r"\W"}[x]


def made():
    rng = random.Random(3)
    for i, r in enumerate(BUILT_IN):
        left = 4
        for _ in range(60):
            text = rng.choice(["", "x ", "= "]) + example(_parser.parse(r.pattern), rng) + rng.choice(["", " y"])
            if re.search("(?i)" + r.pattern, text, re.ASCII) and r.need in text.lower():
                yield i, r, text
                left -= 1
            if not left:
                break


def test_every_rule_can_be_found(spark):
    rows = list(made())
    assert {i for i, *_ in rows} == set(range(len(BUILT_IN)))
    for _, r, text in rows:
        texts = literals.needed(r.pattern)
        assert texts is None or any(x in text.lower() for x in texts), (r.rule_id, text)
    rules = [(i, r.languages, r.need, r.pattern) for i, r in enumerate(BUILT_IN)]
    df = spark.createDataFrame([(i, "any" if "*" in r.languages else r.languages[0], text) for i, r, text in rows], "i int, language string, text string")
    may = df.select("i", "text", literals.candidates(F.col("text"), F.col("language"), rules).alias("may"))
    assert may.where(~F.array_contains("may", F.col("i"))).collect() == []
    # and few others: the index is there to leave most rules out
    assert may.agg(F.avg(F.size("may"))).first()[0] < len(BUILT_IN) / 10


@pytest.mark.parametrize("pattern, want", [(r"eval\(", {"eval("}), (r"(a|bc)+de?f", {"d"}), (r"md5|sha-?1", {"md5", "sha"}), (r"x*", None), (r"[ab]?q*.", None), (r"(?:foo|ba)\s*=", {"foo", "ba"}), (r"ABC[DE]", {"abc"}), (r"é", None)])
def test_needed(pattern, want):
    assert literals.needed(pattern) == (frozenset(want) if want else None)


@pytest.mark.parametrize("words", [["a"], ["a", "ab", "abc"], ["exec", "execute", "eval", "val", "l("], [".x", "+", "\\d", "a b"]])
def test_trie(words):
    longest = re.compile(f"(?=({literals.trie(words)}))")
    for text in ("abcab", "executeval(", "x.x+\\da b", "zz", ""):
        want = [max((w for w in words if text.startswith(w, i)), key=len) for i in range(len(text)) if any(text.startswith(w, i) for w in words)]
        assert longest.findall(text) == want


def test_odd_catalogs(spark):
    """Rules without any needed text, for all languages or none that occurs, and none at all; null and unknown languages; null and empty lines."""
    rule = lambda i, languages, pattern: Rule(i, "high", 1, "A05", "config", languages, i, "", pattern)
    lines = spark.createDataFrame([("a", "python", 1, "x1"), ("b", None, 1, "1"), ("c", "odd", 2, "QZ"), ("d", "python", 3, None), ("e", "python", 4, "")], "path string, language string, line_no long, text string")
    found = lambda *rules: sorted((r.path, r.rule_id) for r in rule_scan(lines, Catalog(list(rules)), 3).collect())
    assert found() == []
    assert found(rule("D", ("*",), r"\d"), rule("P", ("python",), r"[a-z]\d"), rule("Q", ("*",), "qz"), rule("N", ("cobol",), r"\w")) == [("a", "D"), ("a", "P"), ("b", "D"), ("c", "Q")]
