"""Syntax facts of Python files, and what follows from them: complexity, taint between functions, data flow, overviews.

Files cross to Python once, to be parsed: `facts` gives flat rows of all kinds (functions, parameters, calls, assignments as edges, control-flow
edges, what each statement defines and uses), and the rest is joins, aggregates and, for taint and data flow, loops of these (`flows`).
A file that doesn't parse gives one row of kind `error`. `file_facts` solves a single file without Spark, and is what tests hold the relations against.

Deliberate differences to a naive reading: taint is kept by (scope, name), so equal names in two functions don't mix, and the
scope of a function whose name an earlier one of the file has is `name#line`, so equal methods of two classes don't either; the
control-flow graph has try, with, break and continue; every reachable node is visited at least once; a sink inside
a compound statement is checked with the state at its own statement.
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from . import flows
from .flows import ARROW, CLEAN, SANITIZED, TAINTED

SCHEMA = "path string, kind string, scope string, name string, line long, end_line long, a long, b long, c long, text string"
MODULE = "<module>"
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCHES = (ast.If, ast.While, ast.For, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension)
_NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith)
_COGNITIVE = (ast.If, ast.For, ast.While, ast.With, ast.ExceptHandler)
#: Node class: whether it counts as a branch, for the cognitive sum, as a level of nesting.
_WEIGHS = {t: (int(t in _BRANCHES), t in _COGNITIVE, int(t in _NESTING)) for t in {*_BRANCHES, *_NESTING, *_COGNITIVE}}
_WEIGHS_NOT = (0, False, 0)
#: Fields without nodes, or with operators and contexts only, which nothing here reads.
_PLAIN = frozenset("ctx op ops id attr type_comment type_ignores kind module level conversion simple is_async".split())
_FIELDS: dict[type, tuple[str, ...]] = {ast.Constant: ()}
#: The fields of a node that hold statements, or what holds these.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
_HOLDS: dict[type, tuple[str, ...]] = {}


def fields(node: ast.AST) -> tuple[str, ...]:
    """The names of a node's fields that may hold nodes which count."""
    cls = node.__class__
    if (names := _FIELDS.get(cls)) is None:
        names = _FIELDS[cls] = tuple(n for n in cls._fields if n not in _PLAIN)
    return names


def children(node: ast.AST) -> list[ast.AST]:
    """The nodes right below, without operators and contexts."""
    out: list[ast.AST] = []
    for name in fields(node):
        v = getattr(node, name, None)
        if v.__class__ is list:
            out += [x for x in v if isinstance(x, ast.AST)]
        elif isinstance(v, ast.AST):
            out.append(v)
    return out


def below(node: ast.AST, closed: frozenset[type] = frozenset()) -> list[ast.AST]:
    """All nodes below, level by level, but not those of these classes and what is below them."""
    todo = [n for n in children(node) if n.__class__ not in closed]
    put = todo.append
    for n in todo:
        if (names := _FIELDS.get(n.__class__)) is None:
            names = fields(n)
        for name in names:
            v = getattr(n, name, None)
            if v.__class__ is list:
                for x in v:
                    if isinstance(x, ast.AST) and x.__class__ not in closed:
                        put(x)
            elif isinstance(v, ast.AST) and v.__class__ not in closed:
                put(v)
    return todo


def _inner(node: ast.AST) -> list[ast.AST]:
    """The statements right below in their order, and the handlers and cases that hold some; expressions hold none."""
    cls = node.__class__
    if (names := _HOLDS.get(cls)) is None:
        names = _HOLDS[cls] = () if issubclass(cls, ast.expr) else tuple(n for n in cls._fields if n in _BLOCKS)
    return [x for name in names for x in getattr(node, name)] if names else []


def _statements(node: ast.AST) -> list[ast.AST]:
    """All statements below, those of inner functions and classes too."""
    todo = _inner(node)
    for n in todo:
        todo += _inner(n)
    return todo


def dotted(node: ast.AST | None) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        parts.append(dotted(node.func) + "()")
    elif isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def last(name: str) -> str:
    return name.rsplit(".", 1)[-1]


@cache
def _starts(sources: tuple[str, ...]) -> tuple[frozenset[str], tuple[str, ...]]:
    return frozenset(sources), tuple(s + end for s in sources for end in ".(")


def is_source(name: str, sources: tuple[str, ...]) -> bool:
    whole, starts = _starts(sources)
    return name in whole or name.startswith(starts)


def is_sanitizer(name: str, sanitizers: tuple[str, ...]) -> bool:
    return name in sanitizers or last(name) in sanitizers


def _source_of(sources: tuple[str, ...]) -> Callable[[str], bool]:
    """`is_source` for these."""
    whole, starts = _starts(sources)
    return lambda name: name in whole or name.startswith(starts)


def _sanitizer_of(sanitizers: tuple[str, ...]) -> Callable[[str], bool]:
    """`is_sanitizer` for these."""
    known = frozenset(sanitizers)
    return lambda name: name in known or last(name) in known


_taints, _cleans = _source_of(dims.SOURCES), _sanitizer_of(dims.SANITIZERS)
_flows_in, _flow_cleans = _source_of(dims.FLOW_SOURCES), _sanitizer_of(dims.FLOW_SANITIZERS)
_legacy_in, _legacy_cleans = _source_of(dims.LEGACY_SOURCES), _sanitizer_of(dims.LEGACY_SANITIZERS)
#: The last names of the legacy analysis' sinks.
_LEGACY_LAST = frozenset(map(last, dims.LEGACY_SINKS))


@dataclass
class Facts:
    """The facts of these kinds, or of all if there are none."""

    kinds: frozenset[str] = frozenset()
    rows: list[tuple] = field(default_factory=list)

    def wants(self, *kinds: str) -> bool:
        return not self.kinds or not self.kinds.isdisjoint(kinds)

    def add(self, kind: str, scope: str = "", name: str = "", line: int = 0, end_line: int = 0, a: int = 0, b: int = 0, c: int = 0, text: str = "") -> None:
        if not self.kinds or kind in self.kinds:
            self.rows.append((kind, scope, name, line, end_line, a, b, c, text))


# Shape ------------------------------------------------------------------------------------------------------------------------


def _metrics(f: Facts, function: ast.AST, scope: str) -> None:
    """A row for each node of the function's subtree that counts: cyclomatic, cognitive, nesting depth."""
    todo = [(function, 0, 0, False)]
    add, line = f.rows.append, function.lineno
    for node, depth, level, in_bool in todo:
        for child in children(node):
            cls = child.__class__
            if (names := _FIELDS.get(cls)) is None:
                names = fields(child)
            if not names:  # a leaf counts nothing
                continue
            cyclomatic, counts, nests = _WEIGHS.get(cls, _WEIGHS_NOT)
            cognitive, deeper, inner, is_bool = 0, level, depth + nests, cls is ast.BoolOp
            if counts:
                cognitive, deeper = 1 + level, level + 1
            elif is_bool:
                cyclomatic = cognitive = len(child.values) - 1
            if cyclomatic or nests or cognitive:
                add(("metric", scope, "", line, 0, cyclomatic, 0 if in_bool else cognitive, inner, ""))
            todo.append((child, inner, deeper, in_bool or is_bool))


def _function(f: Facts, node: ast.FunctionDef, scope: str, owner: str) -> None:
    if f.wants("function", "raise", "calls"):
        inner = _statements(node)
    if f.wants("function"):
        a = node.args
        doc = (ast.get_docstring(node) or "").split("\n")[0][:100]
        returns = int(any(isinstance(n, ast.Return) and n.value for n in inner))
        f.add("function", owner, scope, node.lineno, node.end_lineno or node.lineno, len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs), int(isinstance(node, ast.AsyncFunctionDef)), returns, doc)
    if f.wants("param"):
        _params(f, node, scope)
    if node.returns and f.wants("returns"):
        f.add("returns", scope, ast.unparse(node.returns), node.lineno)
    if f.wants("raise", "calls"):
        raised = {dotted(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) for n in inner if isinstance(n, ast.Raise) and n.exc}
        for name in sorted(raised - {""}):
            f.add("raise", scope, name, node.lineno)
        called = {dotted(n.func) for n in below(node) if isinstance(n, ast.Call)} - raised - {node.name, ""} if f.wants("calls") else ()
        for name in sorted(called):
            f.add("calls", scope, name, node.lineno)
    if f.wants("metric"):
        _metrics(f, node, scope)


def _params(f: Facts, node: ast.FunctionDef, scope: str) -> None:
    args = node.args
    named = [*args.posonlyargs, *args.args, *args.kwonlyargs]
    defaults = dict(zip([a.arg for a in [*args.posonlyargs, *args.args]][::-1], [ast.unparse(d) for d in args.defaults][::-1], strict=False))
    defaults |= {a.arg: ast.unparse(d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True) if d}
    for i, a in enumerate(x for x in named if x.arg not in ("self", "cls")):
        note = f": {ast.unparse(a.annotation)}" if a.annotation else ""
        f.add("param", scope, a.arg, node.lineno, a=i, text=a.arg + note + (f" = {defaults[a.arg]}" if a.arg in defaults else ""))
    for star, a in (("*", args.vararg), ("**", args.kwarg)):
        if a:
            f.add("param", scope, star + a.arg, node.lineno, a=len(named), text=star + a.arg)


# Taint between functions -------------------------------------------------------------------------------------------------------


@dataclass
class _Taint:
    """Edges between (scope, name) nodes, seeds and sink arguments of one module."""

    f: Facts
    functions: dict[str, ast.FunctionDef]

    def carried(self, e: ast.AST | None, scope: str) -> tuple[set[str], set[str]]:
        """The nodes whose taint the expression carries, and the sources in it."""
        if e is None or isinstance(e, ast.Constant):
            return set(), set()
        if isinstance(e, ast.Name):
            return {f"{scope}:{e.id}"}, {e.id} if e.id in dims.SOURCES else set()
        if isinstance(e, ast.Attribute):
            name = dotted(e)
            if _taints(name):
                return set(), {name}
            nodes, sources = self.carried(e.value, scope)
            return nodes | {f"{scope}:{name}"}, sources
        if isinstance(e, ast.Call):
            name = dotted(e.func)
            if _cleans(name):
                return set(), set()
            if _taints(name):
                return set(), {name}
            args = [a.value if isinstance(a, ast.Starred) else a for a in e.args]
            known = self.functions.get(last(name))
            if known is not None:
                names = [a.arg for a in [*known.args.posonlyargs, *known.args.args]]
                names = names[1:] if names[:1] in (["self"], ["cls"]) else names
                for p, a in zip(names, args, strict=False):
                    self.assign(f"{last(name)}:{p}", a, scope, e.lineno)
                return {f"{last(name)}:<return>"}, set()
            nodes, sources = self.carried(e.func.value, scope) if isinstance(e.func, ast.Attribute) else (set(), set())
            for a in args:
                x, y = self.carried(a, scope)
                nodes, sources = nodes | x, sources | y
            return nodes, sources
        nodes, sources = set(), set()
        for child in children(e):
            if isinstance(child, ast.expr) and not (isinstance(e, ast.IfExp) and child is e.test):
                x, y = self.carried(child, scope)
                nodes, sources = nodes | x, sources | y
        return nodes, sources

    def assign(self, target: str, value: ast.AST | None, scope: str, line: int) -> None:
        nodes, sources = self.carried(value, scope)
        for n in sorted(nodes - {target}):
            self.f.add("edge", n, target, line)
        for s in sorted(sources):
            self.f.add("seed", scope, target, line, text=s)

    def visit(self, body: list[ast.stmt], scope: str) -> None:
        for s in body:
            for n in _own_nodes(s):
                kind = _VISITED.get(n.__class__)
                if kind is None:
                    continue
                if kind == "assign":
                    for t in n.targets:
                        for one in t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]:
                            self.assign(f"{scope}:{dotted(one.value if isinstance(one, ast.Subscript) else one)}", n.value, scope, n.lineno)
                elif kind == "bind":
                    self.assign(f"{scope}:{dotted(n.target)}", n.value, scope, n.lineno)
                elif kind == "each":
                    self.assign(f"{scope}:{dotted(n.target)}", n.iter, scope, getattr(n, "lineno", s.lineno))
                elif kind == "with":
                    if n.optional_vars is not None:
                        self.assign(f"{scope}:{dotted(n.optional_vars)}", n.context_expr, scope, s.lineno)
                elif kind == "return":
                    self.assign(f"{scope}:<return>", n.value, scope, n.lineno)
                else:
                    name = dotted(n.func)
                    end = last(name)
                    if end in dims.SINKS:
                        for i, a in enumerate(n.args):
                            nodes, sources = self.carried(a, scope)
                            for x in sorted(nodes):
                                self.f.add("sinkarg", scope, name, n.lineno, a=i, text=x)
                            for x in sorted(sources):
                                self.f.add("sinkarg", scope, name, n.lineno, a=i, b=1, text=x)
                    if end in self.functions:
                        self.carried(n, scope)


#: What a node of each class is to `_Taint.visit`.
_VISITED = {
    ast.Assign: "assign", ast.AnnAssign: "bind", ast.AugAssign: "bind", ast.NamedExpr: "bind", ast.For: "each", ast.AsyncFor: "each", ast.comprehension: "each",
    ast.withitem: "with", ast.Return: "return", ast.Call: "call",
}


def _calls(f: Facts, body: list[ast.stmt], scope: str) -> None:
    for n in (n for s in body for n in _own_nodes(s) if isinstance(n, ast.Call)):
        f.add("call", scope, dotted(n.func), n.lineno, a=len(n.args))


def _reached(edges: dict[str, set[str]], seeds: set[str]) -> dict[str, str]:
    """Every node that the seeds reach, with the node before it on a shortest way; a seed with itself."""
    before = {x: x for x in sorted(seeds)}
    todo = list(before)
    for x in todo:
        for n in sorted(edges.get(x, ())):
            if n not in before:
                before[n] = x
                todo.append(n)
    return before


def _way(node: str, before: dict[str, str]) -> list[str]:
    """The nodes from a seed to this one."""
    out = [node]
    while before[out[-1]] != out[-1]:
        out.append(before[out[-1]])
    return out[::-1]


def _shown(node: str) -> str:
    scope, name = node.split(":", 1)
    return f"{bare(scope)}()" if name == "<return>" else name


def bare(scope: str) -> str:
    return scope.split("#", 1)[0]


def _close(f: Facts) -> None:
    """What the edges of this file let the seeds reach, and which parameters reach results: a file's graph is solved where it is made.

    A `taint` fact's text is its flow: the source, the names it goes through, and the sink.
    """
    ahead: dict[str, set[str]] = {}
    back: dict[str, set[str]] = {}
    for kind, src, dst, *_ in f.rows:
        if kind == "edge":
            ahead.setdefault(src, set()).add(dst)
            back.setdefault(dst, set()).add(src)
    seeds: dict[str, str] = {}
    for r in f.rows:
        if r[0] == "seed":
            seeds[r[2]] = min(seeds.get(r[2], r[8]), r[8])
    tainted = _reached(ahead, set(seeds))
    for node in sorted(tainted):
        f.add("tainted", name=node)
    into: dict[str, dict[str, str]] = {}
    for kind, scope, name, _, _, a, *_ in list(f.rows):
        if kind == "param":
            if scope not in into:
                into[scope] = _reached(back, {f"{scope}:<return>"})
            if f"{scope}:{name}" in into[scope]:
                f.add("summary", scope, name, a=a)
    for node in sorted(seeds):
        if node.endswith(":<return>"):
            f.add("summary", node.split(":")[0], a=-1)
    for kind, scope, name, line, _, a, b, _, text in list(f.rows):
        if kind == "sinkarg" and (b or text in tainted):
            way = [] if b else _way(text, tainted)
            flow = [text if b else seeds[way[0]], *map(_shown, way), f"{name}()"]
            f.add("taint", scope, name, line, a=a, b=b, c=len(flow), text=ARROW.join(flow))


_CLOSED = frozenset((*FUNCTIONS, ast.ClassDef))


def _own_nodes(s: ast.AST) -> list[ast.AST]:
    """The statement and the nodes below it, but not those of functions and classes inside it."""
    return [] if s.__class__ in _CLOSED else [s, *below(s, _CLOSED)]


# Data flow over a control-flow graph ---------------------------------------------------------------------------------------------


#: Statements after which execution may go on elsewhere than at the next one.
_TURNS = frozenset((ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try, ast.Match, ast.Return, ast.Raise, ast.Break, ast.Continue))


@dataclass
class Graph:
    nodes: list[ast.AST] = field(default_factory=list)
    edges: set[tuple[int, int]] = field(default_factory=set)

    def build(self, body: list[ast.stmt]) -> Graph:
        self._block(body, set(), None, None)
        return self

    def _node(self, s: ast.AST, before: set[int]) -> int:
        at = len(self.nodes)
        self.nodes.append(s)
        for p in before:
            self.edges.add((p, at))
        return at

    def _block(self, body: list[ast.stmt], before: set[int], brk: set[int] | None, cont: int | None) -> set[int]:
        for s in body:
            cls = s.__class__
            if cls in _CLOSED:
                continue
            if self.nodes and not before:
                return before  # nothing after a jump is reached
            at = self._node(s, before)
            if cls not in _TURNS:
                before = {at}
            elif isinstance(s, ast.If):
                before = self._block(s.body, {at}, brk, cont) | (self._block(s.orelse, {at}, brk, cont) if s.orelse else {at})
            elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
                out: set[int] = set()
                self.edges |= {(x, at) for x in self._block(s.body, {at}, out, at)}
                before = (self._block(s.orelse, {at}, brk, cont) if s.orelse else {at}) | out
            elif isinstance(s, (ast.With, ast.AsyncWith)):
                before = self._block(s.body, {at}, brk, cont)
            elif isinstance(s, ast.Try):
                first = len(self.nodes)
                done = self._block(s.body, {at}, brk, cont)
                raised = {at, *range(first, len(self.nodes))}
                done = self._block(s.orelse, done, brk, cont) if s.orelse else done
                for h in s.handlers:
                    done |= self._block(h.body, raised, brk, cont)
                before = self._block(s.finalbody, done | (raised if not s.handlers else set()), brk, cont) if s.finalbody else done
            elif isinstance(s, ast.Match):
                before = {at}.union(*(self._block(c.body, {at}, brk, cont) for c in s.cases))
            elif isinstance(s, (ast.Return, ast.Raise)):
                before = set()
            elif isinstance(s, ast.Break) and brk is not None:
                brk.add(at)
                before = set()
            elif isinstance(s, ast.Continue) and cont is not None:
                self.edges.add((at, cont))
                before = set()
            else:
                before = {at}
        return before


def _heads(s: ast.AST) -> list[ast.expr]:
    """The expressions that a node itself evaluates; a compound statement's bodies have nodes of their own."""
    if isinstance(s, (ast.If, ast.While)):
        return [s.test]
    if isinstance(s, (ast.For, ast.AsyncFor)):
        return [s.iter]
    if isinstance(s, (ast.With, ast.AsyncWith)):
        return [i.context_expr for i in s.items]
    if isinstance(s, ast.Match):
        return [s.subject]
    if isinstance(s, ast.Try):
        return []
    return [n for n in children(s) if isinstance(n, ast.expr)]


Terms = tuple[int, frozenset[str]]


def terms(e: ast.AST | None) -> Terms:
    """What an expression's value is the maximum of: a constant and variables."""
    if e is None or isinstance(e, ast.Constant):
        return CLEAN, frozenset()
    if isinstance(e, ast.Name):
        return (TAINTED, frozenset()) if e.id in dims.FLOW_SOURCES else (CLEAN, frozenset([e.id]))
    if isinstance(e, (ast.Attribute, ast.Subscript)):
        name = dotted(e) if isinstance(e, ast.Attribute) else ""
        return (TAINTED, frozenset()) if name and _flows_in(name) else terms(e.value)
    if isinstance(e, ast.Call):
        name = dotted(e.func)
        if _flow_cleans(name):
            return SANITIZED, frozenset()
        if _flows_in(name):
            return TAINTED, frozenset()
        parts = [e.func.value] if isinstance(e.func, ast.Attribute) else []
        parts += [a.value if isinstance(a, ast.Starred) else a for a in e.args]
    elif isinstance(e, ast.IfExp):
        parts = [e.body, e.orelse]
    else:
        parts = [c for c in children(e) if isinstance(c, ast.expr)]
    own = [terms(p) for p in parts]
    return max([CLEAN, *(v for v, _ in own)]), frozenset().union(*(names for _, names in own))


def value(t: Terms, env: dict[str, int]) -> int:
    return max([t[0], *(env.get(name, CLEAN) for name in t[1])])


def effects(s: ast.AST) -> dict[str, Terms]:
    """A node's effect: the plain names that it assigns, and from what, all as it was before the node."""
    if isinstance(s, ast.Assign):
        own = terms(s.value)
        return {one.id: own for t in s.targets for one in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t]) if isinstance(one, ast.Name)}
    if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
        return {s.target.id: terms(s.value)}
    if isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name):
        floor, names = terms(s.value)
        return {s.target.id: (floor, names | {s.target.id})}
    if isinstance(s, (ast.For, ast.AsyncFor)) and isinstance(s.target, ast.Name):
        return {s.target.id: terms(s.iter)}
    out: dict[str, Terms] = {}
    if isinstance(s, (ast.With, ast.AsyncWith)):
        for i in s.items:
            if isinstance(i.optional_vars, ast.Name):
                floor, names = terms(i.context_expr)  # a later item sees what an earlier one has bound
                bound = [out[n] for n in names if n in out]
                out[i.optional_vars.id] = max([floor, *(v for v, _ in bound)]), frozenset(n for n in names if n not in out).union(*(n for _, n in bound))
    return out


def solve(g: Graph, start: dict[str, int] | None = None) -> list[dict[str, int]]:
    """The state before each node: the least fixpoint. It ends, as states only rise in a finite lattice."""
    before: list[dict[str, int]] = [{} for _ in g.nodes]
    follow: dict[int, list[int]] = {}
    for a, b in sorted(g.edges):
        follow.setdefault(a, []).append(b)
    if g.nodes:
        before[0] = dict(start or {})
    todo, seen = [0] if g.nodes else [], set()
    while todo:
        n = todo.pop(0)
        seen.add(n)
        after = before[n] | {name: value(t, before[n]) for name, t in effects(g.nodes[n]).items()}
        for m in follow.get(n, []):
            joined = {k: max(before[m].get(k, CLEAN), after.get(k, CLEAN)) for k in before[m].keys() | after.keys()}
            if joined != before[m] or m not in seen:
                before[m] = joined
                if m not in todo:
                    todo.append(m)
    return before


def _flow(f: Facts, body: list[ast.stmt], scope: str) -> Graph:
    """The graph's edges, what each node defines from what, and the arguments of sinks, of which each is a constant (end_line 0) or a variable (1)."""
    g = Graph().build(body)
    if f.wants("cfg"):
        f.rows += [("cfg", scope, "", g.nodes[a].lineno, g.nodes[b].lineno, a, b, 0, "") for a, b in sorted(g.edges)]
    place = 0
    for at, n in enumerate(g.nodes if f.wants("def", "use", "flowarg") else ()):
        for name, (floor, names) in sorted(effects(n).items()):
            f.add("def", scope, name, n.lineno, a=at, b=floor)
            for used in sorted(names):
                f.add("use", scope, name, n.lineno, a=at, text=used)
        for e, sink, cwe in _sink_calls(n):
            place += 1
            for floor, names in map(terms, e.args):
                if floor:
                    f.add("flowarg", scope, sink, e.lineno, a=at, b=floor, c=place, text=cwe)
                for used in sorted(names):
                    f.add("flowarg", scope, sink, e.lineno, 1, at, c=place, text=f"{cwe}\t{used}")
    return g


def _sink_calls(n: ast.AST) -> Iterator[tuple[ast.Call, str, str]]:
    for head in _heads(n):
        for e in (head, *below(head)):
            if isinstance(e, ast.Call) and (sink := last(dotted(e.func))) in dims.FLOW_SINKS:
                yield e, sink, dims.FLOW_SINKS[sink][0]


def _solved(f: Facts, g: Graph, scope: str) -> None:
    done = set()
    for n, env in zip(g.nodes, solve(g), strict=True):
        for e, sink, cwe in _sink_calls(n):
            if any(value(terms(a), env) == TAINTED for a in e.args) and (e.lineno, cwe) not in done:
                done.add((e.lineno, cwe))
                f.add("flow", scope, sink, e.lineno, text=cwe)


# The legacy analysis: one pass, exact sinks, keyword arguments too -------------------------------------------------------------------


def _legacy(f: Facts, tree: ast.Module) -> None:
    tainted: set[str] = set()

    def hot(e: ast.AST) -> bool:
        if isinstance(e, ast.Constant) or (isinstance(e, ast.Call) and _legacy_cleans(dotted(e.func))):
            return False
        for n in (e, *below(e)):
            cls = n.__class__
            if cls is ast.Name:
                if n.id in tainted:
                    return True
            elif (cls is ast.Call and _legacy_in(dotted(n.func))) or (cls is ast.Attribute and _legacy_in(dotted(n))):
                return True
        return False

    for n in sorted((x for x in below(tree) if isinstance(x, (ast.Assign, ast.Call))), key=lambda x: (x.lineno, x.col_offset)):
        if isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    (tainted.add if hot(n.value) else tainted.discard)(t.id)
        else:
            name = dotted(n.func)
            if last(name) in _LEGACY_LAST:
                sink = next((s for s in dims.LEGACY_SINKS if name == s or name.endswith("." + s)), None)
                if sink and any(hot(v) for v in (*n.args, *(k.value for k in n.keywords))):
                    f.add("legacy", "", sink, n.lineno, text=dims.LEGACY_SINKS[sink][0])
            if any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in n.keywords):
                f.add("legacy", "", "shell=True", n.lineno, text="CWE-78")


def file_facts(text: str) -> list[tuple]:
    """The facts of one file with what follows from them (tainted, summary, taint, flow), without Spark."""
    return parsed(text, solve_too=True)


def parsed(text: str, solve_too: bool = False, kinds: frozenset[str] = frozenset()) -> list[tuple]:
    """The facts of a file, of these kinds or of all: (kind, scope, name, line, end_line, a, b, c, text)."""
    f = Facts(kinds)
    try:
        tree = compile(text, "<unknown>", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        f.add("error", text=type(e).__name__)
        return f.rows
    functions: dict[str, ast.FunctionDef] = {}
    bodies: list[tuple[str, list[ast.stmt]]] = [(MODULE, tree.body)]
    if f.wants("module"):
        guard = any(isinstance(s, ast.If) and isinstance(s.test, ast.Compare) and dotted(s.test.left) == "__name__" for s in tree.body)
        f.add("module", text="script" if guard else "library", a=len(text.splitlines()), b=int(guard))
    todo = [(s, "") for s in reversed(tree.body)]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, FUNCTIONS):
            scope = node.name if node.name not in functions else f"{node.name}#{node.lineno}"
            _function(f, node, scope, owner)
            functions[scope] = node
            bodies.append((scope, node.body))
        elif isinstance(node, ast.ClassDef):
            f.add("class", owner, node.name, node.lineno, node.end_lineno or node.lineno, text=",".join(filter(None, map(dotted, node.bases))))
            owner = node.name
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            for a in node.names:
                f.add("import", "", (f"{node.module or ''}." if isinstance(node, ast.ImportFrom) else "") + a.name, node.lineno)
        if inner := _inner(node):
            todo += [(s, owner) for s in reversed(inner)]
    taint = _Taint(f, functions)
    taints, calls, flow = f.wants("edge", "seed", "sinkarg"), f.wants("call"), f.wants("cfg", "def", "use", "flowarg")
    for scope, body in bodies if taints or calls or flow else ():
        if taints:
            taint.visit(body, scope)
        if calls:
            _calls(f, body, scope)
        if flow:
            g = _flow(f, body, scope)
            if solve_too:
                _solved(f, g, scope)
    if solve_too:
        _close(f)
    if f.wants("legacy"):
        _legacy(f, tree)
    return f.rows


def without_gc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, with Python's search for cycles once a batch only: trees have none, but their many nodes would set it off all the time."""
    gc.disable()
    try:
        for b in batches:
            yield b
            gc.collect()
    finally:
        gc.enable()


_TYPES = dict(x.split() for x in SCHEMA.split(", "))
#: The columns that facts of a kind fill, besides path and kind; the rest is empty or 0.
_FILLED = {
    "error": "text", "module": "text a b", "class": "scope name line end_line text", "import": "name line", "function": "scope name line end_line a b c text", "metric": "scope line a b c",
    "param": "scope name line a text", "returns": "scope name line", "raise": "scope name line", "calls": "scope name line", "edge": "scope name line", "seed": "scope name line text",
    "sinkarg": "scope name line a b text", "call": "scope name line a", "cfg": "scope line end_line a b", "def": "scope name line a b", "use": "scope name line a text",
    "flowarg": "scope name line end_line a b c text", "legacy": "name line text",
}


def _filled(kinds: tuple[str, ...]) -> list[str]:
    """The columns, besides path, that differ between facts of these kinds."""
    own = {c for k in kinds for c in _FILLED[k].split()} | ({"kind"} if len(set(kinds)) > 1 else set())
    return [c for c in _TYPES if c != "path" and (c in own or not kinds)]


def _rows(batches: Iterator[pa.RecordBatch], kinds: frozenset[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """path and these columns of all facts; only what differs crosses from Python, a path as often as its file has facts."""
    places = [(list(_TYPES).index(c) - 1, pa.int64() if _TYPES[c] == "long" else pa.string()) for c in columns]

    def batch(paths: pa.Array, counts: list[int], rows: list[tuple]) -> pa.RecordBatch:
        of = list(zip(*rows, strict=True))
        files = pa.array([i for i, n in enumerate(counts) for _ in range(n)], pa.int32())
        return pa.RecordBatch.from_arrays([paths.take(files).cast(pa.string()), *[pa.array(of[i], t) for i, t in places]], names=["path", *columns])

    for b in batches:
        paths, start, counts, rows = b.column("path"), 0, [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            own = parsed(text or "", kinds=kinds)
            counts.append(len(own))
            rows += own
            if len(rows) > 20_000:
                yield batch(paths.slice(start, len(counts)), counts, rows)
                start, counts, rows = i + 1, [], []
        if rows:
            yield batch(paths.slice(start, len(counts)), counts, rows)


#: The kinds of facts that each of the operators below reads.
COMPLEXITY = ("function", "metric")
TAINT = ("edge", "seed", "sinkarg")
SUMMARY = ("edge", "seed", "param")
FLOW = ("cfg", "def", "use", "flowarg")
OVERVIEW = ("module", "import", "function", "class")
DESCRIPTION = ("function", "param", "returns", "raise", "calls")


def facts(files: DataFrame, *kinds: str) -> DataFrame:
    """The facts of the Python files among (path, language, text), of these kinds or of all; what other kinds need is not worked out."""
    columns = _filled(kinds)
    own = files.where("language = 'python'").select("path", "text").mapInArrow(lambda it: without_gc(_rows(it, frozenset(kinds), columns)), ", ".join(f"{c} {_TYPES[c]}" for c in ("path", *columns)))
    same = {c: F.lit(kinds[0] if c == "kind" else 0 if t == "long" else "").cast(t).alias(c) for c, t in _TYPES.items() if c != "path" and c not in columns}
    return own.select(*[same.get(c, F.col(c)) for c in _TYPES])


def naming(files: DataFrame, *groups: tuple[str, ...]) -> DataFrame:
    """The files whose text holds, of each group of dotted names, the longest part of some name: others can't speak of any, and needn't be parsed.
    A text beyond ASCII stays, as Python folds letters of names."""
    for names in groups:
        parts = sorted({max(n.split("."), key=len) for n in names})
        files = files.where(F.col("text").rlike("|".join([r"[^\x00-\x7F]", *parts])))
    return files


# What follows relationally -------------------------------------------------------------------------------------------------------


def complexity(facts: DataFrame) -> DataFrame:
    """A row for each function: cyclomatic, cognitive, max_nesting, params, lines, n_issues, refactor_priority."""
    own = facts.where("kind in ('function', 'metric')").select("path", F.when(F.col("kind") == "function", F.col("name")).otherwise(F.col("scope")).alias("function"), "line", "kind", "end_line", "a", "b", "c")
    is_f = F.col("kind") == "function"
    g = own.groupBy("path", "function", "line").agg(
        (1 + F.sum(F.when(~is_f, F.col("a")).otherwise(0))).alias("cyclomatic"), F.sum(F.when(~is_f, F.col("b")).otherwise(0)).alias("cognitive"), F.max(F.when(~is_f, F.col("c")).otherwise(0)).alias("max_nesting"),
        F.max(F.when(is_f, F.col("a"))).alias("params"), F.max(F.when(is_f, F.col("end_line") - F.col("line") + 1)).alias("lines"),
    )
    issues = sum(((F.col(c) > n).cast("long") for c, n in (("cyclomatic", 10), ("cognitive", 15), ("max_nesting", 4), ("params", 5), ("lines", 50))), F.lit(0).cast("long"))
    return g.withColumn("function", _bare("function")).withColumn("n_issues", issues).withColumn("refactor_priority", F.when(F.col("n_issues") >= 2, "high").when(F.col("n_issues") == 1, "medium").otherwise("ok"))


_bare = flows.bare


def tainted_names(facts: DataFrame) -> DataFrame:
    """path, node (scope:name) of everything that data from a source may reach."""
    return flows.tainted(facts)


def taint_findings(facts: DataFrame) -> DataFrame:
    """A finding for each line and sink that tainted data reaches, at its first tainted argument, with the shortest flow to it."""
    own = flows.taints(facts).groupBy("path", "scope", "name", "line").agg(F.min(F.struct("a", "c", "text")).alias("x"), F.max("b").alias("near"))
    own = own.select("*", F.col("x.a").alias("arg"), F.col("x.text").alias("flow"))
    sink = F.substring_index("name", ".", -1)
    cwe = dims.mapped(sink, {k: v[0] for k, v in dims.SINKS.items()}, None)
    return own.select(
        "path", F.col("line").alias("line_no"), F.concat(F.lit("TAINT-"), F.replace(cwe, F.lit("-"), F.lit("_"))).alias("rule_id"), dims.mapped(sink, {k: v[1] for k, v in dims.SINKS.items()}, "high").alias("severity"), cwe.alias("cwe"),
        dims.mapped(cwe, dims.CWE_CATEGORY, "code").alias("category"), F.col("name").alias("snippet"), F.when(F.col("near") == 1, "high").otherwise("medium").alias("confidence"), F.lit("taint").alias("source"), "arg", dims.mapped(F.col("name"), dims.FIXES, dims.DEFAULT_FIX).alias("fix"),
        F.col("name").alias("sink"), F.substring_index("flow", ARROW, 1).alias("source_var"), "flow",
    )


def fn_summary(facts: DataFrame) -> DataFrame:
    """path, function, param: parameters that a function's result may carry; -1 for a result that always comes from a source."""
    return flows.summaries(facts).select("path", _bare("scope").alias("function"), F.col("a").alias("param"))


def dataflow_findings(facts: DataFrame) -> DataFrame:
    sev = dims.mapped("name", {k: v[1] for k, v in dims.FLOW_SINKS.items()}, "high")
    return flows.sinks(facts).select("path", F.col("line").alias("line_no"), F.concat(F.lit("DFLOW-"), F.replace("text", F.lit("-"), F.lit("_"))).alias("rule_id"), sev.alias("severity"), F.col("text").alias("cwe"), dims.mapped("text", dims.CWE_CATEGORY, "code").alias("category"), F.col("name").alias("snippet"), F.lit("medium").alias("confidence"), F.lit("dataflow").alias("source"))


def explain_files(facts: DataFrame) -> DataFrame:
    """An overview of each file that parses: numbers of things, whether it is a script, its first imports and functions."""
    n = lambda k: F.count_if(F.col("kind") == k)
    named = F.when(F.col("kind").isin("import", "function"), F.struct("kind", _bare("name").alias("name")))
    own = facts.where("kind in ('module', 'import', 'function', 'class')").groupBy("path").agg(
        n("function").alias("functions"), n("class").alias("classes"), n("import").alias("imports"), F.max(F.when(F.col("kind") == "module", F.col("a"))).alias("loc"), F.max(F.when(F.col("kind") == "module", F.col("text"))).alias("purpose"),
        F.collect_list(named).alias("named"),
    )
    names = lambda k, most: F.array_join(F.slice(F.array_sort(F.array_distinct(_those("named", k, "name"))), 1, most), ",")
    return own.select("path", "functions", "classes", "imports", "loc", "purpose", names("import", 8).alias("import_names"), names("function", 6).alias("function_names"))


def _those(rows: str, kind: str, value: str) -> Column:
    """This value of each of the rows of a kind, in a list of rows."""
    return F.expr(f"transform(filter({rows}, r -> r.kind = '{kind}'), r -> r.{value})")


def describe_functions(facts: DataFrame) -> DataFrame:
    """params, returns, raises, calls of each function; two of one name are two rows."""
    own = facts.where("kind in ('function', 'param', 'returns', 'raise', 'calls')").select("path", F.when(F.col("kind") == "function", F.col("name")).otherwise(F.col("scope")).alias("function"), "kind", "name", "a", "text")
    own = own.repartition("path", "function").groupBy("path", "function").agg(F.collect_list(F.struct("kind", "name", F.struct("a", "text").alias("param"))).alias("rows"))
    texts = lambda k: F.array_join(F.array_sort(F.array_distinct(_those("rows", k, "name"))), ",")
    params = F.array_join(F.transform(F.array_sort(_those("rows", "param", "param")), lambda x: x["text"]), ", ")
    return own.select("path", _bare("function").alias("function"), params.alias("params"), texts("returns").alias("returns"), texts("raise").alias("raises"), texts("calls").alias("calls"))
