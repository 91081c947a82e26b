"""Rules one by one: matches, look-alikes, needed texts, time on long lines; registration."""

import re
import time

import pytest

from sievelight.operators.catalog import BUILT_IN, Catalog, Rule
from sievelight.operators.detect import rule_scan

#: rule, language, a line that it finds, a line that it doesn't
PAIRS = [
    ("INJ-SQL-001", "python", 'cur.execute(f"select {x}")', 'cur.execute("select 1")'),
    ("INJ-CMD-001", "python", "subprocess.run(c, shell=True)", "subprocess.run(c)"),
    ("INJ-EVAL-001", "python", "y = eval(x)", "y = literal_evaluate(x)"),
    ("DES-YAML-001", "python", "yaml.load(f)", "yaml.load(f, Loader=SafeLoader)"),
    ("AUTH-SECRET-001", "ruby", 'password = "hunter2hunter"', 'password = ""'),
    ("SSRF-001", "python", "requests.get(url)", 'requests.get("http://x")'),
    ("HTML-XSS-001", "javascript", "e.innerHTML = v", 'e.innerHTML = "x"'),
    ("HTML-IFRAME-SANDBOX-001", "html", "<iframe src=x>", "<iframe sandbox src=x>"),
    ("RUST-UNSAFE-001", "rust", "unsafe { x() }", "let unsafety = 1;"),
    ("SH-CURL-PIPE-001", "shell", "curl http://x | sh", "curl http://x -o f"),
    ("SQL-DROP-001", "sql", "DROP TABLE t", "DROP TABLE IF EXISTS t"),
    ("GO-SQL-001", "go", 'db.Query("SELECT a WHERE b=" + c)', 'db.Query("SELECT 1", c)'),
    ("JAVA-HASH-001", "java", 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    ("RB-DESER-001", "ruby", "Marshal.load(x)", "Marshal.dump(x)"),
    ("R-EVAL-001", "r", "eval(parse(text=x))", "evaluate(x)"),
]


def test_pairs(spark):
    rows = [(f"{i}.{k}", lang, 1, line) for i, (_, lang, good, bad) in enumerate(PAIRS) for k, line in (("hit", good), ("miss", bad))]
    found = {(r.path, r.rule_id) for r in rule_scan(spark.createDataFrame(rows, "path string, language string, line_no long, text string"), depth=3).collect()}
    for i, (rule, *_) in enumerate(PAIRS):
        assert (f"{i}.hit", rule) in found, rule
        assert (f"{i}.miss", rule) not in found, rule


def test_needed_text_is_needed():
    """A pattern's literal parts hold its needed text: no line made of the pattern's example can match without it."""
    for r in BUILT_IN:
        assert r.need == r.need.lower()
        if r.need:
            plain = re.sub(r"\\(.)", r"\1", r.pattern).lower()
            assert r.need in plain or any(c in plain for c in ("[^", "|", "(?", "?", "s+")), r.rule_id


def test_time_on_a_long_line():
    line = "A" * 50_000
    for r in BUILT_IN:
        began = time.perf_counter()
        re.search("(?i)" + r.pattern, line)
        assert time.perf_counter() - began < 0.3, r.rule_id


def test_register():
    c = Catalog()
    n = len(c.rules)
    c.register(Rule("OWN-1", "low", 1, "A05", "config", ("python",), "own", "abc", r"abc\("))
    assert len(c.rules) == n + 1
    for bad in (Rule("OWN-1", "low", 1, "A05", "config", ("*",), "", "", "x"), Rule("OWN-2", "bad", 1, "A05", "config", ("*",), "", "", "x"), Rule("OWN-3", "low", 1, "A05", "config", ("*",), "", "", r"(a+)+"), Rule("OWN-4", "low", 1, "A05", "config", ("*",), "", "", r"x(?=y)")):
        with pytest.raises(ValueError):
            c.register(bad)


@pytest.mark.parametrize("text", ["", "# only a comment", "def broken(:", "größe = 'ü'", "def add(a, b):\n    return a + b"])
def test_clean_files(spark, text):
    rows = [("a.py", "python", i + 1, x) for i, x in enumerate(text.split("\n"))]
    assert rule_scan(spark.createDataFrame(rows, "path string, language string, line_no long, text string")).count() == 0
