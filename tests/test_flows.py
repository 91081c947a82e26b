"""Taint and data flow as relations give what the solver of a single file gives, on generated programs and chosen ones."""

import random

import pytest

from sievelight.operators import flows, fixpoint
from sievelight.operators import syntax as S

FILES = "path string, language string, text string"
NAMES = ["a", "b", "c", "d"]


def _body(rng: random.Random, depth: int, indent: str, functions: list[str]) -> list[str]:
    out = []
    name = lambda: rng.choice(NAMES)
    for _ in range(rng.randint(1, 4)):
        kind = rng.randint(0, 15 if depth else 10)
        more = lambda: _body(rng, depth - 1, indent + "    ", functions)
        match kind:
            case 0: out.append(f"{indent}{name()} = input()")
            case 1: out.append(f"{indent}{name()} = escape({name()})")
            case 2: out.append(f"{indent}{name()} = {name()} + {name()}")
            case 3: out.append(f"{indent}{name()} += {name()}.strip()")
            case 4: out.append(f"{indent}cursor.execute({name()}, 1); eval({name()})")
            case 5: out.append(f"{indent}{name()}, {name()} = {name()}, request.args.get('k')")
            case 6: out.append(f"{indent}{name()} = {rng.choice(functions)}({name()}, {name()})")
            case 7: out.append(f"{indent}{name()} = {name()} if {name()} else ''")
            case 8: out.append(f"{indent}os.system({name()}); os.system(input())")
            case 9: out.append(f"{indent}{name()} = 'x'")
            case 10: out.append(f"{indent}{name()}: str = f'{{{name()}}}'")
            case 11: out += [f"{indent}if {name()}:", *more(), f"{indent}else:", *more()]
            case 12: out += [f"{indent}while {name()}:", *more(), f"{indent}    {rng.choice(['break', 'continue', 'pass'])}"]
            case 13: out += [f"{indent}for {name()} in {name()}:", *more()]
            case 14: out += [f"{indent}try:", *more(), f"{indent}except E:", *more()]
            case 15: out += [f"{indent}with open({name()}) as {name()}, {name()} as {name()}:", *more()]
    return out + ([f"{indent}return {name()}"] if rng.random() < 0.5 else [])


def _program(rng: random.Random) -> str:
    functions = ["f", "g", "f"][: rng.randint(1, 3)]
    return "\n".join(line for f in functions for line in [f"def {f}({rng.choice(NAMES)}, p):", *_body(rng, 2, "    ", functions), ""])


@pytest.fixture(scope="module")
def programs(spark):
    rng = random.Random(7)
    texts = {f"m{i}.py": _program(rng) for i in range(150)} | {"none.py": "", "bad.py": "def f(:\n", "chain.py": "def f():\n    v0 = input()\n" + "".join(f"    v{i + 1} = v{i}\n" for i in range(25)) + "    eval(v25)\n"}
    return texts, S.facts(spark.createDataFrame([(p, "python", t) for p, t in texts.items()], FILES)).cache()


def _plain(texts, kind):
    return [(p, *r[1:]) for p, t in texts.items() for r in S.file_facts(t) if r[0] == kind]


def test_taint_equals_the_plain_solver(programs):
    texts, facts = programs
    want = {(p, scope, name, line, a, b, c, text) for p, scope, name, line, _, a, b, c, text in _plain(texts, "taint")}
    own = [tuple(r) for r in flows.taints(facts).collect()]
    assert len(want) > 200 and any(r[6] > 4 for r in want) and set(own) == want
    assert sorted(map(tuple, flows.tainted(facts).collect())) == sorted((r[0], r[2]) for r in _plain(texts, "tainted"))


def test_summaries_equal_the_plain_solver(programs):
    texts, facts = programs
    want = {(r[0], r[1], r[5]) for r in _plain(texts, "summary")}
    assert len(want) > 50 and {tuple(r) for r in flows.summaries(facts).collect()} == want


def test_data_flow_equals_the_plain_solver(programs):
    texts, facts = programs
    want = sorted((r[0], r[1], r[3], r[8], r[2]) for r in _plain(texts, "flow"))
    assert len(want) > 100 and sorted(map(tuple, flows.sinks(facts).collect())) == want


def test_states_of_a_loop(spark):
    text = "def f(x):\n    v = ''\n    while x:\n        w = v\n        v = escape(w)\n        v += input()\n    return v\n"
    own = flows.states(S.facts(spark.createDataFrame([("a.py", "python", text)], FILES)))
    got = {(r.node, r.name): r.value for r in own.collect()}
    assert got == {(1, "v"): 3, (1, "w"): 3, (2, "v"): 3, (2, "w"): 3, (3, "v"): 3, (3, "w"): 3, (4, "v"): 1, (4, "w"): 3, (5, "v"): 3, (5, "w"): 3}


def test_no_files(spark):
    facts = S.facts(spark.createDataFrame([], FILES))
    assert flows.taints(facts).count() == flows.sinks(facts).count() == flows.summaries(facts).count() == flows.states(facts).count() == 0


def test_rounds_are_merged(spark):
    rounds = fixpoint.Rounds(spark, "test", 3)
    for i in range(9):
        rounds.add(spark.createDataFrame([(i,)], "i long"))
    assert len(rounds.tables) <= 4 and sorted(r.i for r in rounds.known().collect()) == list(range(9))
