"""Detectors over lines: the rule scan, secrets, anti-patterns, and the filters around them.

A scan of lines never leaves the JVM. One pass finds which of all rules' needed texts a line holds (`literals`), which leaves few rules
of the line's language to try; these are exploded, get pattern and attributes from a broadcast table of the catalog's size, and are tested.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .catalog import Catalog, Rule
from .literals import candidates

#: A line that writes down a rule instead of doing what the rule looks for: compiled or matched patterns, ids of rules and
#: weaknesses, tables of rules, patterns or signatures, and lines that begin with a raw string.
DEFINITION = r"""(?i)^\s*r["']|(re\.compile|rlike|regexp_[a-z_]+)\(|rule_?id\s*[=:]|cwe-[0-9]|(^|[^0-9a-z])(rules?|patterns?|signatures?)\s*(:[^=]*)?=([^=]|$)"""
#: Categories whose dangerous calls take text, and calls that turn text into something harmless or refuse it.
SAFE_FOR = ("sql", "command", "rce", "xss", "ssti", "xpath", "ldap")
SAFE_CALL = r"(?i)(escape|quote|linkify|bleach\.clean|(sanitiz|validat)[a-z_]*|is_safe[a-z_]*|secure_filename|literal_eval|safe_load|compare_digest)\s*\("
#: Files of tests by their folder or by the first or last word of their name.
TEST_PATH = r"(?i)(^|/)(tests?|specs?|__tests__)/|(^|/)(test|spec)[_.-][^/]*$|[_.-](test|spec)s?\.[^/.]+$"


def is_comment(text: Column, marks: tuple[str, ...] = ("#", "//", "*")) -> Column:
    return reduce(lambda a, b: a | b, [F.trim(text).startswith(m) for m in marks])


def is_definition(text: Column) -> Column:
    return text.rlike(DEFINITION)


def is_safe_context(text: Column, category: Column) -> Column:
    return category.isin(*SAFE_FOR) & text.rlike(SAFE_CALL)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def tried(rows: DataFrame, rules: list[tuple[int, Rule]], *columns: str, pattern: Callable[[Rule], str] = lambda r: r.pattern) -> DataFrame:
    """`columns` and rule_seq: a row for each rule that may match the row's `text` in its `language`.

    An outer explode, as of a plain one the optimizer derives a filter, which would look up all texts twice."""
    may = candidates(F.col("text"), F.col("language"), [(i, r.languages, r.need, pattern(r)) for i, r in rules])
    return rows.select(*columns, F.explode_outer(may).alias("rule_seq")).where("rule_seq is not null")


def rule_scan(lines: DataFrame, catalog: Catalog | None = None, depth: int = 2, filters: bool = True, rules: list[tuple[int, Rule]] | None = None, **of) -> DataFrame:
    """Findings of (path, language, line_no, text): a row for each line and rule that match, with the rule's attributes.

    Lines are read one by one; `file_rules.file_scan` also finds what goes over lines. `rules` replaces the catalog's choice."""
    catalog = catalog or Catalog()
    rules = catalog.of(depth, **of) if rules is None else rules
    lines = lines.select("path", "language", "line_no", T.long_line_guard("text").alias("text")).where(F.trim("text") != "")
    if filters:
        lines = lines.where(~is_comment(F.col("text")) & ~is_definition(F.col("text")))
    found = tried(lines, rules, "path", "line_no", "text")
    cols = ["rule_seq", "rule_id", "severity", "cwe", "owasp", "category", "title", "confidence", "pattern"]
    dim = catalog.table(lines.sparkSession).select(*cols, "need", F.when(F.col("unless") != "", F.concat(F.lit("(?i)"), "unless")).alias("_unless"))
    found = found.join(F.broadcast(dim), "rule_seq").where(F.lower("text").contains(F.col("need")))
    text = F.col("text")
    # Cheap tests first: the needed text above, then the pattern, then what excludes a match.
    found = found.where(F.rlike(text, F.concat(F.lit("(?i)"), "pattern"))).where(F.col("_unless").isNull() | ~F.rlike(text, F.col("_unless")))
    if filters:
        found = found.where(~is_safe_context(F.col("text"), F.col("category")))
        if depth < 3:
            found = found.where(~is_test_path(F.col("path")) | (F.col("severity") == "critical"))
    col = F.regexp_instr(F.col("text"), F.concat(F.lit("(?i)"), F.col("pattern"))) - 1
    return found.select("path", "line_no", col.alias("col"), "rule_id", "severity", "cwe", "owasp", "category", "title", T.snippet("text").alias("snippet"), "confidence", F.lit("rule").alias("source"), "rule_seq")


#: Published formats of keys: provider, severity, pattern.
_KEY_FORMATS = (
    ("AWS Access Key", "critical", r"AKIA[0-9A-Z]{16}"), ("GitHub Token", "critical", r"gh[pousr]_[0-9a-zA-Z]{36,}"), ("GitLab Token", "critical", r"glpat-[0-9a-zA-Z_-]{20}"), ("Slack Token", "high", r"xox[baprs]-[0-9a-zA-Z-]{10,}"),
    ("Stripe Key", "critical", r"sk_(live|test)_[0-9a-zA-Z]{24,}"), ("Google API Key", "high", r"AIza[0-9A-Za-z_-]{35}"), ("JWT Token", "medium", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\."),
    ("Private Key", "critical", r"-----BEGIN (RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
)
#: Values without a format of their own, told by what stands before them.
_NAMED_KEYS = (
    ("AWS Secret Key", "critical", r"(?i)aws[a-z0-9_. -]*[\"']?\s*(:|=>?|,)\s*[\"'][a-z0-9/+]{40}[\"']"),
    ("Generic API Secret", "high", r"(?i)(api|app|client|consumer)[a-z0-9]*[ _-]?secret[a-z0-9_]*[\"']?\s*(:|=>?)\s*[\"'][^\"'\s]{16,}[\"']"),
    ("Database URL", "high", r"(?i)(postgres(ql)?|mysql|mariadb|mongodb(\+srv)?|redis|amqps?)://[^\s:/@\"']*:[^\s@/\"']+@"),
)
PROVIDERS = _KEY_FORMATS + _NAMED_KEYS
#: A line that speaks of a secret, and a string of at least 20 signs and no blank in quotes of one kind.
SECRET_HINT = r"(?i)passw|passphrase|pwd|secret|token|credential|bearer|auth|(api|access|private|signing)[ _-]?key"
QUOTED_TOKEN = r"""\"[^\"\s]{20,}\"|'[^'\s]{20,}'"""


def secret_id(name: Column | str) -> Column:
    return F.concat(F.lit("SECRET-"), F.upper(F.replace(F.col(name) if isinstance(name, str) else name, F.lit(" "), F.lit("-"))))


def secret_providers(lines: DataFrame) -> DataFrame:
    """Findings of known key formats; the snippet is redacted."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(s).alias("severity"))) for n, s, p in PROVIDERS]))
    found = lines.where(~is_comment(F.col("text"), ("#", "//"))).select("path", "line_no", "text", F.explode_outer(hits).alias("x")).where("x is not null")
    return found.select("path", "line_no", secret_id("x.name").alias("rule_id"), F.col("x.severity").alias("severity"), F.lit("CWE-798").alias("cwe"), F.lit("secrets").alias("category"), F.substring(T.redact(F.trim("text")), 1, 120).alias("snippet"), F.lit("high").alias("confidence"), F.lit("secret-scanner").alias("source"))


def secret_entropy(lines: DataFrame, threshold: float = 4.0) -> DataFrame:
    """The first quoted token of a secret-like line whose entropy exceeds the threshold."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit(QUOTED_TOKEN), F.lit(0)), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))
    some = lines.where(F.col("text").rlike(SECRET_HINT) & F.col("text").rlike(QUOTED_TOKEN))
    scored = F.transform(tokens, lambda t: F.struct(t.alias("token"), T.entropy(t).alias("bits")))
    first = F.get(F.filter(scored, lambda x: (x["bits"] > threshold) & ~T.looks_like_path(x["token"])), F.lit(0))
    found = some.select("path", "line_no", "text", first.alias("x")).where("x is not null")
    return found.select("path", "line_no", F.lit("SECRET-HIGH-ENTROPY").alias("rule_id"), F.lit("high").alias("severity"), F.lit("CWE-798").alias("cwe"), F.lit("secrets").alias("category"), F.substring(T.redact(F.trim("text")), 1, 120).alias("snippet"), F.lit("medium").alias("confidence"), F.lit("entropy").alias("source"), F.col("x.bits").alias("bits"))


_NO_WORD = "[^0-9A-Za-z_.]"
_DEF = r"^\s*(async\s+)?def\s+[^(]+\("
#: Anti-patterns: id, severity, title, pattern; case matters. AP-STRING-CONCAT-LOOP looks at two lines.
ANTIPATTERNS = (
    ("AP-MAGIC-NUMBER", "low", "number without a name", rf"(^|{_NO_WORD})[1-9][0-9]{{2,}}({_NO_WORD}|$)"),  # three digits and more, not within a word or a fraction
    ("AP-MUTABLE-DEFAULT", "high", "mutable default argument", _DEF + r"[^#]*[^=!<>]=\s*(\[|\{|(list|dict|set)\()"),
    ("AP-BARE-EXCEPT", "high", "bare except", r"^\s*except\s*:"),
    ("AP-LONG-PARAM-LIST", "medium", "long parameter list", _DEF + r"[^,)]*(,[^,)]*){6,}\)"),  # seven parameters and more
    ("AP-NESTED-TERNARY", "low", "nested conditional expression", r"[^\s:]\s+if\s[^:]*\selse\s[^:]*\sif\s[^:]*\selse\s"),
    ("AP-WILDCARD-IMPORT", "low", "import of everything", r"^\s*from\s+[0-9A-Za-z_.]+\s+import\s*\(?\s*\*"),
    ("AP-PRINT-IN-CODE", "low", "print instead of logging", rf"(^|{_NO_WORD})print\s?\("),
    ("AP-BOOL-COMPARE", "low", "comparison with a truth value", r"[=!]=\s*(True|False)([^0-9A-Za-z_]|$)|(^|[^0-9A-Za-z_])(True|False)\s*[=!]="),
    ("AP-OPEN-NO-CTX", "medium", "file opened without a context", r"^\s*[A-Za-z_][0-9A-Za-z_.]*\s*(:[^=]+)?=\s*((io|codecs|gzip)\.)?open\s*\("),
)
LOOP_HEAD = r"^\s*((async\s+)?for\s.+\sin\s|while\s).*:\s*(#.*)?$"
LOOP_CONCAT = r"^\s+[A-Za-z_][0-9A-Za-z_.]*\s*\+=\s*[fF]?[\"']"


def antipatterns(lines: DataFrame) -> DataFrame:
    """Anti-pattern findings; a concatenation in a loop is found by the line before it."""
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("path").orderBy("line_no"))
    lines = lines.select("path", "line_no", T.long_line_guard("text").alias("text")).withColumn("before", before)
    make = lambda i, s, t: F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(t).alias("title"))
    hits = [F.when(F.col("text").rlike(p), make(i, s, t)) for i, s, t, p in ANTIPATTERNS]
    hits.append(F.when(F.col("before").rlike(LOOP_HEAD) & F.col("text").rlike(LOOP_CONCAT), make("AP-STRING-CONCAT-LOOP", "medium", "string built in a loop")))
    found = lines.where(~is_comment(F.col("text"), ("#",))).select("path", "line_no", "text", F.explode_outer(F.array_compact(F.array(*hits))).alias("x")).where("x is not null")
    return found.select("path", "line_no", F.col("x.id").alias("rule_id"), F.col("x.severity").alias("severity"), F.col("x.title").alias("title"), T.snippet("text", 100).alias("snippet"))
