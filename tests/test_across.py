"""The rule scan over lines' ends: calls that go on in later lines, and what in them excludes a match."""

from sievelight import api
from sievelight.operators.file_rules import file_rule_scan, file_scan

FILE = "path string, language string, text string"


def scan(spark, *rows, **k):
    return {(r.path, r.line_no, r.col, r.rule_id) for r in file_scan(spark.createDataFrame(list(rows), FILE), **k).collect()}


def test_calls_over_lines(spark):
    call = "import subprocess\n  subprocess.run(\n    cmd,\n    shell=True,\n)\n"
    rows = [("a.py", "python", call), ("b.py", "python", call.replace("\n", "\r\n")), ("c.py", "python", "# subprocess.run(\n#  c, shell=True)\n"), ("d.py", "python", "subprocess.run(\n  cmd)\nf(shell=True)\n")]
    assert scan(spark, *rows) == {("a.py", 2, 2, "INJ-CMD-001"), ("b.py", 2, 2, "INJ-CMD-001")}
    found = api.analyze(spark.createDataFrame(rows[:1], FILE)).findings.collect()
    assert ("a.py", 2, "INJ-CMD-001") in {(r.path, r.line_no, r.rule_id) for r in found}


def test_one_row_for_a_line_and_rule(spark):
    """Matches within a line are those of the line scan; a line feed before a word doesn't move a match."""
    assert scan(spark, ("a.py", "python", "x = 1\n\neval(a); eval(b)\neval(\n  c)\n")) == {("a.py", 3, 0, "INJ-EVAL-001"), ("a.py", 4, 0, "INJ-EVAL-001")}
    long = "y" * 2001
    assert scan(spark, ("a.py", "python", f"eval('{long}')\neval(b)\n")) == {("a.py", 2, 0, "INJ-EVAL-001")}


def test_excluded_in_a_later_line(spark):
    rows = [("a.py", "python", "yaml.load(\n  f,\n  Loader=SafeLoader)\n"), ("b.py", "python", "yaml.load(\n  f)\nSafeLoader\n"), ("c.py", "python", "yaml.load(f); yaml.load(g)\n"), ("d.html", "html", "<iframe\n src=a\n sandbox>\n<iframe src=b>")]
    assert scan(spark, *rows) == {("b.py", 1, 0, "DES-YAML-001"), ("c.py", 1, 0, "DES-YAML-001"), ("d.html", 4, 0, "HTML-IFRAME-SANDBOX-001")}


def test_route_with_sql(spark):
    rows = [("a.py", "python", "@app.route('/a')\ndef a():\n    db.execute(q)\n"), ("b.py", "python", "@app.route('/a')\ndef a():\n    return 1\n")]
    assert [(r.path, r.rule_id, r.line_no) for r in file_rule_scan(spark.createDataFrame(rows, FILE)).collect()] == [("a.py", "FW-FLASK-004", 1)]
