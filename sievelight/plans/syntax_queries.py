"""Queries over syntax facts. The modules' templates are known, so the SQL states the facts of each template."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import detect as D
from ..operators import findings as O
from ..operators import fixpoint, flows, refactor
from ..operators import syntax as S
from ..operators.file_rules import file_rule_scan, file_scan
from ..sources import corpus as C
from ..sources import sinks
from ..sources.corpus import quoted as q
from ..sources.files import to_lines
from .listed import listed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def stated(columns: str, rows: list[tuple], of: tuple[str, ...] = C.MODULES) -> str:
    """SQL of rows (template, values): each for every event of its template; {n} in a text is the event's number."""
    names = columns.split()
    value = lambda v: q(v) if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    body = ", ".join(f"({k}, " + ", ".join(map(value, r)) + ")" for k, *r in rows)
    shown = ", ".join(f"replace(t.{c}, '{{n}}', CAST(event_id AS VARCHAR)) AS {c}" if isinstance(rows[0][i + 1], str) else f"t.{c} AS {c}" for i, c in enumerate(names))
    return f"SELECT 'm' || event_id || '.py' AS path, {shown} FROM events JOIN (VALUES {body}) t(kind, {', '.join(names)}) ON event_id % {len(of)} = t.kind"


def facts(spark, d, *kinds: str, names: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """The facts of the modules; with `names`, of those that speak of one of each group."""
    return S.facts(S.naming(C.modules(spark, d), *names), *kinds)


#: What a file with a finding of each analysis has to speak of.
TAINTED = (dims.SOURCES, tuple(dims.SINKS))
FLOWING = (dims.FLOW_SOURCES, tuple(dims.FLOW_SINKS))


#: function, line, cyclomatic, cognitive, max_nesting, params, lines, n_issues, refactor_priority of the templates' functions
_SHAPES = [
    (0, "plain_{n}", 1, 1, 0, 0, 2, 2, 0, "ok"), (1, "branchy_{n}", 1, 9, 18, 5, 6, 10, 3, "high"), (2, "read_{n}", 3, 1, 0, 0, 0, 4, 0, "ok"), (3, "clean_{n}", 1, 1, 0, 0, 0, 4, 0, "ok"), (4, "half_{n}", 1, 2, 1, 1, 1, 5, 0, "ok"),
    (5, "helper_{n}", 1, 1, 0, 0, 1, 2, 0, "ok"), (5, "use_{n}", 4, 1, 0, 0, 0, 3, 0, "ok"), (7, "get", 4, 2, 1, 1, 2, 5, 0, "ok"), (8, "loop_{n}", 1, 3, 2, 1, 1, 11, 0, "ok"),
]
_SHAPE = stated("function line cyclomatic cognitive max_nesting params lines n_issues refactor_priority", _SHAPES)


@query(f"SELECT path, function, cyclomatic FROM ({_SHAPE})")
def complexity_cyclomatic(spark, d):
    return S.complexity(facts(spark, d, *S.COMPLEXITY)).select("path", "function", "cyclomatic")


@query(f"SELECT path, function, cognitive FROM ({_SHAPE})")
def complexity_cognitive(spark, d):
    return S.complexity(facts(spark, d, *S.COMPLEXITY)).select("path", "function", "cognitive")


@query(f"SELECT path, function, max_nesting, params, lines FROM ({_SHAPE})")
def complexity_shape(spark, d):
    return S.complexity(facts(spark, d, *S.COMPLEXITY)).select("path", "function", "max_nesting", "params", "lines")


@query(f"SELECT path, function, n_issues, refactor_priority FROM ({_SHAPE})")
def complexity_priority(spark, d):
    return S.complexity(facts(spark, d, *S.COMPLEXITY)).select("path", "function", "n_issues", "refactor_priority")


@query(stated("function param", [(0, "plain_{n}", 0), (0, "plain_{n}", 1), (1, "branchy_{n}", 4), (5, "helper_{n}", 0), (7, "get", 0)]))
def fn_summary(spark, d):
    return S.fn_summary(facts(spark, d, *S.SUMMARY, names=(("return",),)))


@query(stated("node", [(2, "read_{n}:name"), (2, "read_{n}:cmd"), (3, "clean_{n}:name"), (4, "half_{n}:v"), (5, "helper_{n}:p"), (5, "helper_{n}:<return>"), (5, "use_{n}:t"), (8, "loop_{n}:q")]))
def taint_interproc(spark, d):
    return S.tainted_names(facts(spark, d, *S.TAINT[:2], names=TAINTED[:1]))


_TAINT = [(2, 6, "TAINT-CWE_78", "high", "CWE-78", "os.system"), (3, 4, "TAINT-CWE_89", "critical", "CWE-89", "cursor.execute"), (4, 5, "TAINT-CWE_89", "critical", "CWE-89", "cursor.execute"), (5, 6, "TAINT-CWE_95", "critical", "CWE-95", "eval"), (8, 5, "TAINT-CWE_89", "critical", "CWE-89", "cursor.execute")]
_FLOW = [(2, 6, "DFLOW-CWE_78", "high", "CWE-78", "system"), (4, 5, "DFLOW-CWE_89", "critical", "CWE-89", "execute"), (5, 6, "DFLOW-CWE_95", "critical", "CWE-95", "eval"), (8, 5, "DFLOW-CWE_89", "critical", "CWE-89", "execute")]


@query(stated("line_no rule_id severity cwe snippet", _TAINT))
def taint_findings(spark, d):
    return S.taint_findings(facts(spark, d, *S.TAINT, names=TAINTED)).select("path", "line_no", "rule_id", "severity", "cwe", "snippet")


@query(stated("line_no rule_id severity cwe snippet", _FLOW))
def dataflow_findings(spark, d):
    return S.dataflow_findings(facts(spark, d, *S.FLOW, names=FLOWING)).select("path", "line_no", "rule_id", "severity", "cwe", "snippet")


@query(f"WITH t AS ({stated('line_no rule_id severity cwe snippet', _TAINT)}), f AS ({stated('line_no rule_id severity cwe snippet', _FLOW)}), e AS (SELECT *, 'taint' AS source FROM t UNION ALL SELECT *, 'dataflow' FROM f) SELECT path, line_no, cwe, arg_max(rule_id, source) AS rule_id, CASE WHEN count(*) > 1 THEN 'confirmed' ELSE 'medium' END AS confidence FROM e GROUP BY path, line_no, cwe")
def merged_syntax(spark, d):
    own = fixpoint.kept(facts(spark, d, *S.TAINT, *S.FLOW, names=tuple(a + b for a, b in zip(TAINTED, FLOWING, strict=True))), "facts")
    return O.merged(S.taint_findings(own), S.dataflow_findings(own)).select("path", "line_no", "cwe", "rule_id", "confidence")


@query(stated("scope name n_args", [(2, "read_{n}", "os.system", 1), (3, "clean_{n}", "cursor.execute", 1), (4, "half_{n}", "cursor.execute", 1), (5, "use_{n}", "eval", 1), (8, "loop_{n}", "cursor.execute", 1)]))
def sink_calls(spark, d):
    """Calls whose last name is a sink's: an equi-join with the table of sinks."""
    sinks_ = spark.createDataFrame([(k,) for k in dims.FLOW_SINKS], "sink string")
    calls = facts(spark, d, "call", names=FLOWING[1:]).withColumn("sink", F.substring_index("name", ".", -1))
    return calls.join(F.broadcast(sinks_), "sink").select("path", "scope", "name", F.col("a").alias("n_args"))


#: template, scope, node, next node: the edges of all templates. Nodes count a body's statements from 0, nested ones in their order; a return or raise has no next.
_EDGES = [
    (1, "branchy_{n}", 0, 1), (1, "branchy_{n}", 0, 6), (1, "branchy_{n}", 1, 2), (1, "branchy_{n}", 1, 8), (1, "branchy_{n}", 2, 1), (1, "branchy_{n}", 2, 3), (1, "branchy_{n}", 3, 1), (1, "branchy_{n}", 3, 4),
    (1, "branchy_{n}", 4, 3), (1, "branchy_{n}", 4, 5), (1, "branchy_{n}", 6, 7), (1, "branchy_{n}", 6, 8), (2, "read_{n}", 0, 1), (2, "read_{n}", 1, 2), (3, "clean_{n}", 0, 1), (3, "clean_{n}", 1, 2),
    (4, "half_{n}", 0, 1), (4, "half_{n}", 1, 2), (4, "half_{n}", 1, 3), (4, "half_{n}", 2, 3), (5, "use_{n}", 0, 1), (7, "<module>", 0, 1), (7, "<module>", 1, 2), (7, "get", 0, 1), (7, "get", 1, 2), (7, "get", 1, 3),
    (8, "loop_{n}", 0, 1), (8, "loop_{n}", 1, 2), (8, "loop_{n}", 2, 3), (8, "loop_{n}", 2, 5), (8, "loop_{n}", 3, 4), (8, "loop_{n}", 4, 2), (8, "loop_{n}", 5, 6), (8, "loop_{n}", 5, 8), (8, "loop_{n}", 6, 7),
]


@query(stated("scope src dst", _EDGES))
def cfg_edges(spark, d):
    """The edges of the control-flow graphs of all modules."""
    return facts(spark, d, "cfg").select("path", "scope", F.col("a").alias("src"), F.col("b").alias("dst"))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT path || ':' || scope AS f, src, dst FROM ({stated('scope src dst', _EDGES)})), r(f, node) AS (SELECT DISTINCT f, CAST(0 AS BIGINT) FROM e UNION SELECT r.f, e.dst FROM r JOIN e ON e.f = r.f AND e.src = r.node) SELECT f || ':' || node AS node FROM r")
def dataflow_fixpoint(spark, d):
    """The nodes that execution can reach from each function's first one, over the control-flow graphs of all modules."""
    return flows.reachable(facts(spark, d, "cfg")).select(F.concat_ws(":", "path", "scope", F.col("node").cast("string")).alias("node"))


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    cell = lambda v: q(v) if isinstance(v, str) else f"CAST({v} AS BIGINT)"
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)})"


def _of_events(columns: str, source: str) -> str:
    """SQL that gives each event's module the rows of its template."""
    shown = ", ".join(f"replace(x.{c[1:]}, '{{n}}', CAST(event_id AS VARCHAR)) AS {c[1:]}" if c.startswith("$") else f"x.{c}" for c in columns.split())
    return f"SELECT 'm' || event_id || '.py' AS path, {shown} FROM events JOIN ({source}) x ON event_id % {len(C.MODULES)} = x.kind"


#: template, scope, node, variable, value of the constant part (1 sanitised, 3 tainted) of each assignment
_DEFS = [
    (1, "branchy_{n}", 1, "i", 0), (2, "read_{n}", 0, "name", 3), (2, "read_{n}", 1, "cmd", 0), (3, "clean_{n}", 0, "name", 3), (3, "clean_{n}", 1, "name", 1), (4, "half_{n}", 0, "v", 3), (4, "half_{n}", 2, "v", 1),
    (5, "use_{n}", 0, "t", 3), (8, "loop_{n}", 0, "out", 0), (8, "loop_{n}", 1, "q", 0), (8, "loop_{n}", 4, "q", 3), (8, "loop_{n}", 6, "x", 0),
]
#: template, scope, node, variable, variable that its value comes from
_USES = [(2, "read_{n}", 1, "cmd", "name")]
_STATES = f"""WITH RECURSIVE {_values("e", "kind, scope, src, dst", _EDGES)}, {_values("d", "kind, scope, node, name, floor", _DEFS)}, {_values("u", "kind, scope, node, name, used", _USES)},
  m AS (SELECT * FROM u UNION SELECT n.kind, n.scope, n.node, v.name, v.name FROM (SELECT kind, scope, src AS node FROM e) n JOIN (SELECT DISTINCT kind, scope, name FROM d) v USING (kind, scope) ANTI JOIN d USING (kind, scope, node, name)),
  r(kind, scope, node, name, value) AS (
    SELECT e.kind, e.scope, e.dst, d.name, d.floor FROM d JOIN e ON e.kind = d.kind AND e.scope = d.scope AND e.src = d.node WHERE d.floor > 0
    UNION SELECT e.kind, e.scope, e.dst, m.name, r.value FROM r JOIN m ON m.kind = r.kind AND m.scope = r.scope AND m.node = r.node AND m.used = r.name JOIN e ON e.kind = m.kind AND e.scope = m.scope AND e.src = m.node)
{_of_events("$scope node name value", "SELECT kind, scope, node, name, max(value) AS value FROM r GROUP BY ALL")}"""


@query(_STATES)
def dataflow_states(spark, d):
    """What each variable may hold before each statement, over loops and branches of which one sanitises."""
    return flows.states(facts(spark, d, *S.FLOW[:3], names=(dims.FLOW_SOURCES + dims.FLOW_SANITIZERS,)))


#: template, node, next node; template, node, source; template, node, sink, line
_CARRIES = [(2, "read_{n}:name", "read_{n}:cmd"), (5, "helper_{n}:p", "helper_{n}:<return>"), (5, "helper_{n}:<return>", "use_{n}:t")]
_SOURCES = [(2, "read_{n}:name", "request.args.get"), (3, "clean_{n}:name", "request.args.get"), (4, "half_{n}:v", "input"), (5, "helper_{n}:p", "input"), (8, "loop_{n}:q", "input")]
_AIMS = [(2, "read_{n}:cmd", "os.system", 6), (3, "clean_{n}:name", "cursor.execute", 4), (4, "half_{n}:v", "cursor.execute", 5), (5, "use_{n}:t", "eval", 6), (8, "loop_{n}:q", "cursor.execute", 5)]
_NAMED = "CASE WHEN {0} LIKE '%:<return>' THEN split_part({0}, ':', 1) || '()' ELSE split_part({0}, ':', 2) END"
_FLOWS = f"""WITH RECURSIVE {_values("e", "kind, src, dst", _CARRIES)}, {_values("s", "kind, node, source_var", _SOURCES)}, {_values("k", "kind, node, sink, line_no", _AIMS)},
  r(kind, node, source_var, flow, n) AS (SELECT kind, node, source_var, source_var || ' -> ' || {_NAMED.format("node")}, 1 FROM s
    UNION ALL SELECT e.kind, e.dst, r.source_var, r.flow || ' -> ' || {_NAMED.format("e.dst")}, r.n + 1 FROM r JOIN e ON e.kind = r.kind AND e.src = r.node)
{_of_events("line_no source_var sink $flow", "SELECT k.kind, line_no, arg_min(source_var, n) AS source_var, sink, arg_min(flow || ' -> ' || sink || '()', n) AS flow FROM r JOIN k ON k.kind = r.kind AND k.node = r.node GROUP BY ALL")}"""


@query(_FLOWS)
def taint_flows(spark, d):
    """The way from a source to each sink that it reaches, over functions."""
    return S.taint_findings(facts(spark, d, *S.TAINT, names=TAINTED)).select("path", "line_no", "source_var", "sink", "flow")


@query(stated("line_no sink cwe", [(2, 6, "os.system", "CWE-78"), (5, 6, "eval", "CWE-95")]))
def legacy_taint(spark, d):
    # Without a source there is no finding, except for a shell.
    return facts(spark, d, "legacy", names=((*dims.LEGACY_SINKS, "shell"), (*dims.LEGACY_SOURCES, "shell"))).select("path", F.col("line").alias("line_no"), F.col("name").alias("sink"), F.col("text").alias("cwe"))


#: template, functions, classes, imports, loc, purpose, function names
_OVERVIEW = [(0, 1, 0, 0, 2, "library", "plain_{n}"), (1, 1, 0, 0, 10, "library", "branchy_{n}"), (2, 1, 0, 1, 6, "library", "read_{n}"), (3, 1, 0, 0, 4, "library", "clean_{n}"), (4, 1, 0, 0, 5, "library", "half_{n}"), (5, 2, 0, 0, 6, "library", "helper_{n},use_{n}"), (7, 1, 1, 1, 11, "script", "get"), (8, 1, 0, 0, 11, "library", "loop_{n}")]


@query(stated("functions classes imports loc purpose function_names", _OVERVIEW))
def explain_files(spark, d):
    return S.explain_files(facts(spark, d, *S.OVERVIEW)).drop("import_names")


#: template, function, parameters, returns, raises, calls
_DESCRIBED = [(0, "plain_{n}", "a, b", "", "", ""), (1, "branchy_{n}", "a, b, c, d, e, f", "", "", "range"), (2, "read_{n}", "", "", "", "os.system,request.args.get"), (3, "clean_{n}", "", "", "", "cursor.execute,int,request.args.get"), (4, "half_{n}", "flag", "", "", "cursor.execute,escape,input"), (5, "helper_{n}", "p", "", "", "p.strip"), (5, "use_{n}", "", "", "", "eval,helper_{n},input"), (7, "get", "key: str = 'k'", "str", "KeyError", "lookup"), (8, "loop_{n}", "items", "", "", "cursor.execute,input,len")]


@query(stated("function params returns raises calls", _DESCRIBED))
def describe_functions(spark, d):
    return S.describe_functions(facts(spark, d, *S.DESCRIPTION))


def _explained() -> list[tuple[int, str]]:
    imports = {2: ["os"], 7: ["sys"]}
    out = []
    for k, functions, classes, n_imports, loc, purpose, names in _OVERVIEW:
        own = [dict(zip(("function", "params", "returns", "raises", "calls"), r, strict=True)) for t, *r in _DESCRIBED if t == k]
        body = {"path": "m{n}.py", "purpose": purpose, "loc": loc, "functions": functions, "classes": classes, "imports": n_imports, "import_names": imports.get(k, []), "function_names": names.split(","), "described": own}
        out.append((k, json.dumps(body, separators=(",", ":"))))
    return out


@query(stated("json", _explained()))
def explain_report(spark, d):
    """The overview of each file with its functions, as one JSON object."""
    own = fixpoint.kept(facts(spark, d, *S.OVERVIEW, *S.DESCRIPTION), "explained")
    return sinks.explained(S.explain_files(own), S.describe_functions(own))


@query(f"SELECT rule, category, count(*) AS n FROM ({stated('rule category', [(7, 'eq-none', 'idiom'), (8, 'len-gt0', 'idiom')])}) GROUP BY rule, category")
def refactor_by_category(spark, d):
    return refactor.changes(C.modules(spark, d), 2).groupBy("rule", "category").agg(F.count("*").alias("n"))


#: template, rule, line, before, after, category of the change in each template of `corpus.REWRITES` that has one
_REWRITES = [
    (0, 'eq-none', 2, 'x == None', 'x is None', 'idiom'),
    (1, 'neq-none', 2, 'x != None', 'x is not None', 'idiom'),
    (2, 'double-not', 2, 'not not x', 'bool(x)', 'idiom'),
    (3, 'not-in', 2, 'not x in y', 'x not in y', 'idiom'),
    (4, 'not-is', 2, 'not x is y', 'x is not y', 'idiom'),
    (5, 'not-eq', 2, 'not x == 1', 'x != 1', 'idiom'),
    (6, 'not-neq', 2, 'not x != 1', 'x == 1', 'idiom'),
    (7, 'eq-true', 2, 'x == True', 'x', 'idiom'),
    (8, 'eq-false', 2, 'x == False', 'not x', 'idiom'),
    (9, 'len-gt0', 2, 'len(x) > 0', 'bool(x)', 'idiom'),
    (10, 'len-eq0', 2, 'len(x) == 0', 'not x', 'idiom'),
    (11, 'type-eq', 2, 'type(x) == str', 'isinstance(x, str)', 'idiom'),
    (12, 'dict-keys-membership', 2, 'k in d.keys()', 'k in d', 'idiom'),
    (13, 'genexpr-in-aggregate', 2, 'sum([i * i for i in x])', 'sum((i * i for i in x))', 'idiom'),
    (14, 'merge-if', 2, 'if x:\n    if y:\n        go()', 'if x and y:\n    go()', 'structure'),
    (15, 'if-return-bool', 2, 'if x > 1:\n    return True\nelse:\n    return False', 'return x > 1', 'idiom'),
    (16, 'range-len-enumerate', 2, 'for i in range(len(x)):\n    go(i, x[i])', 'for i, x_item in enumerate(x):\n    go(i, x_item)', 'idiom'),
    (17, 'aug-assign', 2, 'x = x + 1', 'x += 1', 'idiom'),
    (18, 'dead-code', 3, 'go(x)', 'pass', 'cleanup'),
    (19, 'extract-condition', 2, 'if x and y and (x > 1) and (y > 1):\n    go()', 'condition_1 = x and y and (x > 1) and (y > 1); if condition_1:\n    go()', 'structure'),
    (20, 'guard-clause', 3, 'if x:\n    go(1)\n    go(2)\n    go(y)', 'if not x:\n    return', 'structure'),
    (21, 'named-constant', 2, '404', 'HTTP_NOT_FOUND', 'naming'),
]


@query(stated("rule line before after category", _REWRITES, C.REWRITES))
def refactor_changes(spark, d):
    """Every rewrite, and files that none touches."""
    return refactor.changes(C.rewrites(spark, d), 3)


#: template, header of the function, its stub's first word, parameters, whether it returns something
_STUBS = [
    (0, "def plain_{n}(a, b):\n", "Plain", ("a", "b"), True), (1, "def branchy_{n}(a, b, c, d, e, f):\n", "Branchy", ("a", "b", "c", "d", "e", "f"), True), (2, "def read_{n}():\n", "Read", (), False), (3, "def clean_{n}():\n", "Clean", (), False),
    (4, "def half_{n}(flag):\n", "Half", ("flag",), False), (5, "def helper_{n}(p):\n", "Helper", ("p",), True), (5, "def use_{n}():\n", "Use", (), False), (8, "def loop_{n}(items):\n", "Loop", ("items",), True),
]


def _stubbed() -> list[tuple[int, str]]:
    texts = list(C.MODULES)
    for k, header, word, params, returns in _STUBS:
        body = [f"{word} {{n}}.", *(["", "Args:", *(f"    {x}:" for x in params)] if params else []), *(["", "Returns:", "    the result."] if returns else [])]
        texts[k] = texts[k].replace(header, header + '    """' + "\n".join([body[0], *(("    " + x).rstrip() for x in body[1:])]) + '\n    """\n')
    return list(enumerate(texts))


@query(stated("text", _stubbed()))
def docstring_stubs(spark, d):
    return refactor.documented(C.modules(spark, d))


def _scanned(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a scan of the modules finds: all detectors' findings, merged and less what inline marks take away; anti-patterns; all functions. Each file is parsed once."""
    files = C.modules(spark, d)
    lines = to_lines(files)
    own = fixpoint.kept(S.facts(files, *S.TAINT, *S.FLOW, *S.COMPLEXITY), "facts")
    found = O.merged(S.taint_findings(own), file_scan(files), file_rule_scan(files), D.secret_providers(lines), D.secret_entropy(lines), S.dataflow_findings(own))
    return O.suppress_inline(found, O.suppressions(lines)), D.antipatterns(lines), S.complexity(own)


_FINDING = "line_no rule_id severity cwe snippet"
_LISTED = listed(stated("text", list(enumerate(C.MODULES))), stated(_FINDING, _TAINT), stated(_FINDING, _FLOW), _SHAPE)


@query(_LISTED)
def ide_union(spark, d):
    """Findings, anti-patterns and complex functions of all modules as one list."""
    return sinks.ide_union(*_scanned(spark, d))


@query(f"SELECT count(*) AS total FROM ({_LISTED})")
def project_totals(spark, d):
    """How many findings, anti-patterns and complex functions all modules have."""
    return ide_union(spark, d).agg(F.count("*").alias("total"))


@query(f"WITH t AS ({stated('line_no rule_id severity cwe snippet', _TAINT)}), p AS (SELECT path, sum(CASE severity WHEN 'critical' THEN 25 ELSE 12 END) AS p FROM t GROUP BY path) SELECT 'm' || event_id || '.py' AS path, CAST(100 - coalesce(p, 0) - CASE event_id % 9 WHEN 1 THEN 3 ELSE 0 END AS BIGINT) AS score, CASE WHEN coalesce(p, 0) <= 10 THEN 'A' WHEN coalesce(p, 0) <= 25 THEN 'B' ELSE 'C' END AS grade FROM events LEFT JOIN p ON p.path = 'm' || event_id || '.py'")
def file_score_syntax(spark, d):
    own = fixpoint.kept(facts(spark, d, *S.TAINT, *S.COMPLEXITY), "facts")
    return O.file_score(C.modules(spark, d), S.taint_findings(own), S.complexity(own))
