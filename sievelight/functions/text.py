"""Scalar functions over source text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dims

LONG_LINE = 2000


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def file_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def suffix(path: Column | str) -> Column:
    """The lower-cased suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def detect_language(path: Column | str) -> Column:
    by_suffix = dims.mapped(suffix(path), dims.SUFFIXES, "unknown")
    return F.coalesce(dims.mapped(F.lower(file_name(path)), dims.BUILD_FILES, None), by_suffix)


def comment_prefix(language: Column | str) -> Column:
    return dims.mapped(_c(language), {lang: mark for mark, langs in dims.COMMENTS.items() for lang in langs.split()}, "#")


def match_line_no(text: Column | str, start: Column) -> Column:
    """The line from 1 of the character at `start` (from 0)."""
    before = F.substring(_c(text), F.lit(1), start.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def match_col(text: Column | str, start: Column) -> Column:
    """The column from 0 of the character at `start`."""
    return F.length(F.substring_index(F.substring(_c(text), F.lit(1), start.cast("int")), "\n", -1))


def snippet(text: Column | str, most: int = 120) -> Column:
    return F.substring(F.trim(_c(text)), 1, most)


def redact(text: Column | str) -> Column:
    """Quoted tokens of 12 and more characters keep their first four and last two."""
    return F.regexp_replace(_c(text), r"""(["'])([0-9a-zA-Z_/+=.-]{4})[0-9a-zA-Z_/+=.-]{6,}([0-9a-zA-Z_/+=.-]{2})(["'])""", "$1$2***REDACTED***$3$4")


def normalise_line(text: Column | str) -> Column:
    """For clones: no comment, empty string literals, zero for numbers, single blanks."""
    t = F.regexp_replace(_c(text), "#.*$", "")
    t = F.regexp_replace(t, "\"[^\"]*\"|'[^']*'", "\"\"")
    t = F.regexp_replace(t, "(^|[^0-9A-Za-z_])[0-9]+", "$10")  # one group, so this is the group and a zero
    return F.trim(F.regexp_replace(t, r"[ \t\r\f\x0B]+", " "))


def entropy(token: Column) -> Column:
    """Shannon's entropy in bits of the token's characters."""
    n = F.length(token)
    parts = F.transform(F.array_distinct(F.split(token, "")), lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n)
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def long_line_guard(text: Column | str, most: int = LONG_LINE) -> Column:
    """Lines too long for the patterns become blanks of equal length, which keeps offsets."""
    return F.when(F.length(_c(text)) > most, F.repeat(F.lit(" "), F.length(_c(text)))).otherwise(_c(text))


def looks_like_path(token: Column) -> Column:
    slashes = F.length(token) - F.length(F.replace(token, F.lit("/"), F.lit("")))
    return ((slashes >= 2) & ~token.contains(" ")) | token.startswith("http")


def html_escape(text: Column | str) -> Column:
    t = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def place_fingerprint(cwe: Column | str, path: Column | str, line: Column | str) -> Column:
    """Changes when the line moves."""
    return F.substring(F.md5(F.concat_ws(":", _c(cwe), _c(path), _c(line).cast("string"))), 1, 12)


def fingerprint(rule_id: Column | str, path: Column | str, text: Column | str) -> Column:
    """Stays when the line moves."""
    return F.substring(F.sha2(F.concat_ws(":", _c(rule_id), _c(path), F.trim(_c(text))), 256), 1, 16)


def glob_to_regex(glob: Column | str) -> Column:
    t = F.regexp_replace(_c(glob), r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(t, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def pascal_case(title: Column | str, words: int = 4) -> Column:
    """The first words of a title, each with a capital, joined."""
    return F.replace(F.initcap(F.array_join(F.slice(F.split(F.trim(F.regexp_replace(_c(title), "[^A-Za-z0-9 ]", "")), " +"), 1, words), " ")), F.lit(" "), F.lit(""))


def grade(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 55, "C").when(s >= 35, "D").otherwise("F")
