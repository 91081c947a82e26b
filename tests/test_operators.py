"""Operators against plain Python on small inputs, and what must not change."""

import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelight.functions import text as T
from sievelight.operators import findings as O
from sievelight.operators import fixpoint, refactor
from sievelight.operators import syntax as S
from sievelight.operators.detect import rule_scan, secret_entropy
from sievelight.sources import files, sinks

LINE = "path string, language string, line_no long, text string"


def scan(spark, text, path="src/a.py"):
    return rule_scan(spark.createDataFrame([(path, "python", i + 1, x) for i, x in enumerate(text.split("\n"))], LINE))


@given(st.lists(st.integers(0, 3), min_size=3, max_size=3))
def test_lattice_join(x):
    a, b, c = x
    assert max(a, max(b, c)) == max(max(a, b), c) and max(a, b) == max(b, a) and max(a, a) == a


def test_flow_half_sanitised():
    bad = "def f(x):\n    v = input()\n    if x:\n        v = escape(v)\n    cursor.execute(v)\n"
    good = "def f(x):\n    v = input()\n    v = escape(v)\n    cursor.execute(v)\n"
    loop = "def f(x):\n    'doc'\n    v = ''\n    for i in x:\n        if i: break\n        cursor.execute(v)\n        v = input()\n"
    tried = "def f():\n    try:\n        v = input()\n    except E:\n        v = ''\n    eval(v)\n"
    assert [[r[5 - 2] for r in S.file_facts(t) if r[0] == "flow"] for t in (bad, good, loop, tried)] == [[5], [], [6], [6]]


def test_taint_between_functions():
    text = "def a(p):\n    return 'x' + p\ndef b():\n    q = a(request.args.get('k'))\n    os.system(q)\ndef c():\n    q = 'ok'\n    os.system(q)\n"
    assert [r[3] for r in S.file_facts(text) if r[0] == "taint"] == [5]


def test_flow_of_taint(spark):
    text = "def a(p):\n    return 'x' + p\ndef b():\n    k = request.args.get('k')\n    q = a(k)\n    os.system(q)\n    eval(input())\n"
    own = S.taint_findings(S.facts(spark.createDataFrame([("a.py", "python", text)], "path string, language string, text string"))).orderBy("line_no").collect()
    assert [(r.line_no, r.source_var, r.sink, r.flow) for r in own] == [(6, "request.args.get", "os.system", "request.args.get -> k -> p -> a() -> q -> os.system()"), (7, "input", "eval", "input -> eval()")]


def test_equal_names_in_two_classes(spark):
    text = "class A:\n    def get(self, x):\n        v = input()\n        return v\nclass B:\n    def get(self, y):\n        v = 'ok'\n        eval(v)\n        return lookup(y)\n"
    facts = S.facts(spark.createDataFrame([("a.py", "python", text)], "path string, language string, text string")).cache()
    assert S.taint_findings(facts).count() == 0
    assert sorted((r.function, r.params, r.calls) for r in S.describe_functions(facts).collect()) == [("get", "x", "input"), ("get", "y", "eval,lookup")]
    assert sorted((r.function, r.line, r.lines) for r in S.complexity(facts).collect()) == [("get", 2, 3), ("get", 6, 4)]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 6)], "src int, dst int")
    assert sorted(r[0] for r in fixpoint.closure(edges, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]


def test_clone_pairs_equal_plain_python(spark):
    rng = random.Random(1)
    lines = [rng.choice(["x = 1", "y = 22", "", "z()", "# c", "w = 'a'"]) for _ in range(300)]
    df = spark.createDataFrame([("a", i + 1, x) for i, x in enumerate(lines)], "path string, line_no long, text string")
    norm = ["x = 0", "y = 0", "", "z()", "", 'w = ""']
    own = [dict(zip(["x = 1", "y = 22", "", "z()", "# c", "w = 'a'"], norm, strict=True))[x] for x in lines]
    first, want = {}, []
    for i in range(len(own) - 3):
        block = tuple(own[i : i + 4])
        if all(block):
            if block in first:
                want.append((first[block], i + 1))
            first.setdefault(block, i + 1)
    assert sorted((r.first_line, r.duplicate_line) for r in O.clone_pairs(df, 4).collect()) == sorted(want)


def test_suppression_removes_one_row(spark):
    text = "eval(a)\neval(b)\neval(c)"
    for mark, left in (("# nosec", 2), ("# sievelight:ignore[INJ-EVAL-001]", 2), ("# sievelight:ignore[OTHER]", 3), ("// sievelight: ignore", 2)):
        own = text.replace("eval(b)", "eval(b)  " + mark)
        df = spark.createDataFrame([("a.py", "python", i + 1, x) for i, x in enumerate(own.split("\n"))], LINE)
        assert O.suppress_inline(rule_scan(df), O.suppressions(df)).count() == left, mark


def test_fingerprint_ignores_place(spark):
    a, b = scan(spark, "eval(a)"), scan(spark, "x = 1\n\neval(a)")
    f = lambda df: O.with_fingerprint(df).select("fingerprint").collect()
    assert f(a) == f(b)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LINE)
    found = rule_scan(none)
    assert found.count() == 0 and O.severity_summary(found).count() == 0 and O.fail_on(found, "low").first()[0] == 0
    assert O.compliance_summary(found).where("compliant").count() == 5
    assert secret_entropy(none).count() == 0 and O.clone_pairs(none).count() == 0


def test_merge_chain(spark):
    rule = scan(spark, "x\nos.system(v)")
    taint = spark.createDataFrame([("src/a.py", 2, "TAINT-CWE_78", "high", "CWE-78", "injection", "os.system", "medium", "taint")], "path string, line_no long, rule_id string, severity string, cwe string, category string, snippet string, confidence string, source string")
    own = O.merged(rule, taint).collect()
    assert [(r.rule_id, r.confidence) for r in own] == [("TAINT-CWE_78", "confirmed")]


def test_refactor():
    text = "def f(a):\n    if a == None:\n        return True\n    else:\n        return False\n"
    new, changes = refactor.refactor(text, 2)
    assert new == "def f(a):\n    return a is None\n" and [c[0] for c in changes] == ["eq-none", "if-return-bool"]
    assert refactor.refactor(text, 1)[0] == "def f(a):\n    if a is None:\n        return True\n    else:\n        return False\n"
    assert refactor.refactor("def f(:", 2) == ("def f(:", [])
    cases = {
        "x = not not y": "x = bool(y)", "x = not a in b": "x = a not in b", "x = not a == b": "x = a != b", "x = type(a) == int": "x = isinstance(a, int)", "x = k in d.keys()": "x = k in d", "x = sum([i for i in y])": "x = sum((i for i in y))",
        "x = x + 1": "x += 1", "if a:\n    if b:\n        c()": "if a and b:\n    c()", "x = len(y) == 0": "x = not y",
    }
    for old, want in cases.items():
        assert refactor.refactor(old, 2)[0] == want + "\n", old
    assert refactor.refactor("x = 404", 3)[0] == "HTTP_NOT_FOUND = 404\nx = HTTP_NOT_FOUND\n"
    dead = "def f():\n    return 1\n    x = 2\n"
    assert refactor.refactor(dead, 2)[0] == "def f():\n    return 1\n"
    loop = "for i in range(len(a)):\n    print(a[i])\n"
    assert refactor.refactor(loop, 2)[0] == "for i, a_item in enumerate(a):\n    print(a_item)\n"


def test_docstrings_parse():
    out = refactor.docstrings("def f(a):\n    return a\n")
    assert '"""F.' in out and "a:" in out
    compile(out, "x", "exec")


def test_config():
    assert files.merge_config({"depth": None}, "not json") == {"depth": 2, "all": False, "ignore_rule": [], "fail_on": None}


def test_read_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_bytes(b"eval(x)\nA\xffB\n")
    (tmp_path / "src/b.txt").write_text("eval(x)")
    (tmp_path / "node_modules/c.js").write_text("eval(x)")
    own = files.read_files(spark, str(tmp_path)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.language, r.text) for r in own] == [("a.py", "python", "eval(x)\nAB\n")]


def test_read_files_below_a_skipped_name(spark, tmp_path):
    """What is skipped counts below the target; a dot in a folder's name doesn't make it a file."""
    top = tmp_path / "build" / "proj.v1"
    for name in ("a.py", "notes.txt", "dist/b.py", "sub/pom.xml"):
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text("eval(x)")
    names = lambda df: sorted(r.path.rsplit("proj.v1/", 1)[1] for r in df.collect())
    assert names(files.read_files(spark, str(top))) == ["a.py", "sub/pom.xml"]
    assert names(files.read_files(spark, str(top), recursive=False)) == ["a.py"]
    assert names(files.read_files(spark, str(top / "notes.txt"))) == ["notes.txt"]


def test_baseline_round_trip(spark, tmp_path):
    found = scan(spark, "eval(a)\neval(b)\neval(a)")
    assert files.read_baseline(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("not json")
    assert files.read_baseline(spark, str(tmp_path / "bad.json")).count() == 0
    sinks.write_baseline(O.baseline(found.where("line_no < 2")), str(tmp_path / "b.json"))
    known = files.read_baseline(spark, str(tmp_path / "b.json"))
    assert known.count() == 1 and [r.line_no for r in O.suppress_baseline(found, known).collect()] == [2]


def test_sarif(spark):
    import json

    doc = json.loads(sinks.sarif_document(scan(spark, "eval(a)\nb = eval(c)"), "2020-01-01T00:00:00Z"))
    run = doc["runs"][0]
    assert len(run["tool"]["driver"]["rules"]) == 1 and [r["locations"][0]["physicalLocation"]["region"]["startLine"] for r in run["results"]] == [1, 2]


def test_glob(spark):
    df = spark.createDataFrame([("docs/a.md",), ("src/a.py",)], "path string")
    assert [r.path for r in df.where(F.col("path").rlike(r"^docs/.*$")).collect()] == ["docs/a.md"]
    assert df.select(T.glob_to_regex(F.lit("docs/*.md"))).first()[0] == r"^docs/.*\.md$"
