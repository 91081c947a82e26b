"""Files are parsed for what is asked of them only, and data flow takes passes over functions, not rounds over rows."""

import gc

import pytest

from sievelight.operators import fixpoint, flows, refactor
from sievelight.operators import syntax as S

FILES = "path string, language string, text string"


def test_facts_that_are_not_asked_for_are_not_worked_out(monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(S.ast, "unparse", never)
    monkeypatch.setattr(S, "_metrics", never)
    assert [r[:4] for r in S.parsed("def f(a: int = 1) -> int:\n    if a: g(a)\n", kinds=frozenset({"call"}))] == [("call", "f", "g", 2)]


def test_a_file_that_no_rewrite_touches_is_not_written_anew(monkeypatch):
    def never(*_, **__):
        raise AssertionError

    text = "def f(x):\n    return g(x) + 7\n"
    monkeypatch.setattr(refactor.ast, "unparse", never)
    monkeypatch.setattr(refactor, "names_in", never)
    assert refactor.refactor(text, 3) == (text, [])


def test_cycles_are_not_searched_for_within_a_batch():
    on = [gc.isenabled() for _ in S.without_gc(iter("ab"))]
    assert on == [False, False] and gc.isenabled()


def test_files_that_speak_of_no_name_are_left_out(spark):
    rows = [("a", "input ( )"), ("b", "request . \\\n args.get('q')"), ("c", "x = 1"), ("d", "ｉnput()"), ("e", "def f(v): return v")]
    files = spark.createDataFrame([(p, "python", t) for p, t in rows], FILES)
    assert sorted(r.path for r in S.naming(files, ("input", "request.args")).collect()) == ["a", "b", "d"]
    assert sorted(r.path for r in S.naming(files, ("input", "request.args"), ("get",)).collect()) == ["b", "d"]


def test_a_long_function_takes_few_passes(spark, monkeypatch):
    text = "def f():\n    v0 = input()\n" + "".join(f"    v{i + 1} = v{i}\n" for i in range(100)) + "    eval(v100)\n"
    tables, put = [], fixpoint.kept
    monkeypatch.setattr(flows.fixpoint, "kept", lambda *a: tables.append(a[1]) or put(*a))
    monkeypatch.setattr(flows.fixpoint.Rounds, "add", lambda *_: pytest.fail("a table for each round"))
    own = flows.sinks(S.facts(spark.createDataFrame([("a.py", "python", text)], FILES))).collect()
    assert [(r.scope, r.name, r.line) for r in own] == [("f", "eval", 103)] and len(tables) <= 10


def test_nodes_are_numbered_without_gaps():
    text = "def f(x):\n    try:\n        a()\n    except E:\n        return\n    finally:\n        b()\n    while x:\n        if x: break\n        else: continue\n    match x:\n        case 1: return 2\n    with x: raise x\n"
    edges = [(r[5], r[6]) for r in S.parsed(text, kinds=frozenset({"cfg"})) if r[1] == "f"]
    nodes = {n for e in edges for n in e}
    assert nodes == set(range(len(nodes)))


def test_only_what_differs_between_facts_leaves_python(spark):
    """And the other columns are there all the same."""
    files = spark.createDataFrame([("a.py", "python", "x = 1\ny = x\n"), ("b.py", "python", "def f(:"), ("c.py", "python", "if x:\n    y()\n")], FILES)
    for kinds in (("cfg",), S.TAINT, ()):
        want = sorted((p, *r) for p, t in ((r.path, r.text) for r in files.collect()) for r in S.parsed(t, kinds=frozenset(kinds)))
        own = S.facts(files, *kinds)
        assert own.schema.names == [c.split()[0] for c in S.SCHEMA.split(", ")] and sorted(map(tuple, own.collect())) == want
    assert S._filled(("cfg",)) == ["scope", "line", "end_line", "a", "b"] and len(S._filled(())) == 9


def test_a_long_way_of_taint_takes_no_tables(spark, monkeypatch):
    """Nor is anything parsed twice."""
    monkeypatch.setattr(fixpoint, "kept", lambda *_: pytest.fail("a table"))
    text = "def f(p):\n    v0 = input()\n" + "".join(f"    v{i + 1} = v{i}\n" for i in range(100)) + "    eval(v100)\n    return p\n"
    facts = S.facts(spark.createDataFrame([("a.py", "python", text)], FILES))
    own = flows.taints(facts)
    assert [(r.scope, r.name, r.c, r.text.split(" -> ")[-2:]) for r in own.collect()] == [("f", "eval", 103, ["v100", "eval()"])]
    assert flows.tainted(facts).count() == 101 and [tuple(r) for r in flows.summaries(facts).collect()] == [("a.py", "f", 0)]
    for df in (own, flows.tainted(facts), flows.summaries(facts)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_of_equal_ways_the_first_counts(spark):
    text = "def f():\n    b = input()\n    a = os.getenv('k')\n    d = b\n    c = a\n    e = d\n    e = c\n    eval(e)\n"
    own = flows.taints(S.facts(spark.createDataFrame([("a.py", "python", text)], FILES)))
    assert [r.text for r in own.collect()] == ["os.getenv -> a -> c -> e -> eval()"]


def test_reachable_nodes_take_no_rounds_of_tables(spark, monkeypatch):
    monkeypatch.setattr(fixpoint, "closure", lambda *_: pytest.fail("rounds"))
    text = "def f(x):\n" + "".join(f"    v{i} = x\n" for i in range(60)) + "    while x:\n        if x: continue\n        g()\n    return x\n    h()\n"
    own = flows.reachable(S.facts(spark.createDataFrame([("a.py", "python", text)], FILES), "cfg"))
    assert sorted(tuple(r) for r in own.collect()) == [("a.py", "f", n) for n in range(65)]
