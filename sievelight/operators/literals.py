"""Which rules to try on a text: an index from the literal texts that rules' patterns need to the rules.

Every pattern is reduced to texts of which any match holds at least one. All rules' texts become one pattern, a trie as nested
alternatives behind a lookahead, which gives the longest one at each place of a text in one pass; those that begin it follow from
it. What a text holds is looked up in a literal map, so the cost of a text grows with what it holds, hardly with the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from re import _constants as K
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A needed text that is longer tells no more.
LONG = 24


def _worth(found: frozenset[str]) -> tuple[int, int]:
    return min(min(map(len, found)), 8), -len(found)


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    return max((x for x in (a, b) if x), key=_worth, default=None)


def _of(items: Iterable) -> tuple[frozenset[str] | None, str | None]:
    """The best texts that a match of the parsed sequence holds one of, and the sequence's own text if it is one."""
    best, run, plain = None, "", True
    for op, value in items:
        if op is K.LITERAL and chr(value).isascii():
            run += chr(value).lower()
            continue
        if op is K.AT:
            continue
        inner, own = None, None
        if op is K.SUBPATTERN:
            inner, own = _of(value[-1])
        elif op is K.BRANCH:
            each = [_of(x)[0] for x in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] > 0:
            inner = _of(value[2])[0]
        elif op is K.IN and all(x[0] is K.LITERAL and chr(x[1]).isascii() for x in value):
            inner = frozenset(chr(x[1]).lower() for x in value)
        if own is not None:
            run += own
            continue
        best, run, plain = _better(_better(best, frozenset([run]) if run else None), inner), "", False
    best = _better(best, frozenset([run]) if run else None)
    return best, run if plain else None


@cache
def needed(pattern: str) -> frozenset[str] | None:
    """Lower-case texts of which every match of the pattern, in whatever case, holds one; None if it needs none."""
    found = _of(_parser.parse(pattern))[0]
    return frozenset(x[:LONG] for x in found) if found else None


def trie(words: Iterable[str]) -> str:
    """A pattern for the longest of the words at a place."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        each = [re.escape(c) + pattern(x) for c, x in sorted(node.items()) if c]
        if not each:
            return ""
        group = each[0] if len(each) == 1 and "" not in node else f"(?:{'|'.join(each)})"
        return group + ("?" if "" in node else "")

    return pattern(root)


def candidates(text: Column, language: Column, rules: list[tuple[int, tuple[str, ...], str, str]]) -> Column:
    """Array of the numbers, ascending, of those of `rules` (number, languages, needed text or empty, pattern) that may match a text of the language."""
    of: dict[str, list[int]] = {}
    always = []
    for i, _, need, pattern in rules:
        texts = _better(frozenset([need]) if need else None, needed(pattern))
        for x in texts or ():
            of.setdefault(x, []).append(i)
        if not texts:
            always.append(i)
    numbers = lambda ids: F.array(*[F.lit(i) for i in ids]).cast("array<int>")
    found = numbers(always)
    if of:
        begun = {x: sorted({i for n in range(1, len(x) + 1) for i in of.get(x[:n], ())}) for x in of}
        # A text goes to the rules by a map from a group of equal rule lists, as many texts lead to the same ones.
        table = F.create_map(*[y for x, ids in begun.items() for y in (F.lit(x), numbers(ids))])
        here = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=({trie(of)}))"), F.lit(1)))
        found = F.concat(found, F.flatten(F.transform(here, lambda x: table[x])))
    everywhere = [i for i, languages, *_ in rules if "*" in languages]
    by = {name: sorted({*everywhere, *(i for i, languages, *_ in rules if name in languages)}) for name in sorted({x for _, languages, *_ in rules for x in languages} - {"*"})}
    mine = F.coalesce(F.create_map(*[y for name, ids in by.items() for y in (F.lit(name), numbers(ids))])[language], numbers(everywhere)) if by else numbers(everywhere)
    return F.array_sort(F.array_intersect(found, mine))
