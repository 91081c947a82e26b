"""Queries on whole tables: edges of every template, places of all findings."""

from sievelight.operators import findings as O
from sievelight.operators.syntax import facts
from sievelight.plans import catalog
from sievelight.sources import corpus as C

SF = "/root/testdata/sf0.001"

#: Bodies and their edges as execution goes: branches, both ends of loops, back edges, jumps, nested code.
BODIES = [
    ("a\nb\nc", {(0, 1), (1, 2)}),
    ("if a:\n    b\nelse:\n    c\nd", {(0, 1), (0, 2), (1, 3), (2, 3)}),
    ("while a:\n    b\n    if c:\n        break\n    d\ne", {(0, 1), (1, 2), (2, 3), (2, 4), (4, 0), (0, 5), (3, 5)}),
    ("for x in y:\n    if a:\n        continue\n    b\nreturn c", {(0, 1), (1, 2), (2, 0), (1, 3), (3, 0), (0, 4)}),
    ("for x in y:\n    while a:\n        b\nc", {(0, 1), (1, 2), (2, 1), (1, 0), (0, 3)}),
]


def test_edges_of_every_template(spark):
    found = catalog.QUERIES["cfg_edges"](spark, SF)
    templates = {int(r.path[1:-3]) % len(C.MODULES) for r in found.select("path").distinct().collect()}
    assert templates == {1, 2, 3, 4, 5, 7, 8}  # plain_ has one statement, broken_ doesn't parse


def test_edges_of_a_fixture(spark):
    rows = [(f"{i}.py", "python", "def f():\n" + "".join(f"    {x}\n" for x in body.split("\n"))) for i, (body, _) in enumerate(BODIES)]
    found = facts(spark.createDataFrame(rows, "path string, language string, text string")).where("kind = 'cfg'").collect()
    for i, (body, want) in enumerate(BODIES):
        assert {(r.a, r.b) for r in found if r.path == f"{i}.py"} == want, body


def test_places_of_all_findings(spark):
    """Every finding has its place, over many ranges, with ties and a place for each of equal rows."""
    found = catalog.QUERIES["sort_findings"](spark, SF).collect()
    assert len(found) > 200 and sorted(r.place for r in found) == list(range(1, len(found) + 1))
    severity = ["low", "critical", "info", "high", "medium"]
    rows = [(f"f{i % 7}", i % 50, f"R{i % 3}", severity[i % 5], i % 4) for i in range(1000)] * 2
    df = spark.createDataFrame(rows, "path string, line_no long, rule_id string, severity string, seq long").repartition(8)
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
    want = sorted(rows, key=lambda r: (rank[r[3]], r[0], r[1], r[4], r[2]))
    got = sorted(O.placed(df).collect(), key=lambda r: r.place)
    assert [tuple(r)[1:] for r in got] == want and [r.place for r in got] == list(range(1, 2001))
    assert [tuple(r) for r in O.sort_findings(df).collect()] == want
