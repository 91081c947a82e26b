"""The line detectors' expressions, each against lines that it finds and lines that it doesn't."""

import re

import pytest

from sievelight.operators import detect as D

ANTIPATTERNS = {
    "AP-MAGIC-NUMBER": (["x = 4096 * y", "f(1500)"], ["x = 12", "a1000 = b", "v = 0.12345"]),
    "AP-MUTABLE-DEFAULT": (["def f(a, b=[]):", "def g(x={}, y=1):", "async def h(z=list()):"], ["def f(a, b=None):", "x = []"]),
    "AP-BARE-EXCEPT": (["except:", "    except :"], ["except E:"]),
    "AP-LONG-PARAM-LIST": (["def f(a, b, c, d, e, g, h):"], ["def f(a, b, c):"]),
    "AP-NESTED-TERNARY": (["x = a if b else c if d else e"], ["x = a if b else c", "if a: x"]),
    "AP-WILDCARD-IMPORT": (["from a.b import *"], ["from a import b", "import a"]),
    "AP-PRINT-IN-CODE": (["print(x)", "  print (x)"], ["log.print(x)", "blueprint(x)"]),
    "AP-BOOL-COMPARE": (["if a == True:", "if False != b:"], ["a = True", "if a == Truth:"]),
    "AP-OPEN-NO-CTX": (["f = open(p)", "self.f = io.open(p)"], ["with open(p) as f:", "f = reopen(p)"]),
}
EXPRESSIONS = [
    (D.DEFINITION, ["x = re.compile(y)", "RULES = [eval(x)]", 'r"eval("', "rule_id='A'", "see CWE-89", "patterns: list = [a]"], ["result = eval(data)", "schedules = 1", "if rule == x:", "like(x)"]),
    (D.SAFE_CALL, ["os.system(escape(x))", "q = shlex.quote(a)", "sanitize_html (x)", "yaml.safe_load(f)", "validate(x)"], ["os.system(x)", "escaped = x", "f(unquoted)"]),
    (D.TEST_PATH, ["tests/a.py", "src/test/a.py", "test_a.py", "a/b_test.go", "a.spec.js", "src/a.test.ts"], ["src/latest.py", "contest/a.py", "inspect.py", "src/attest_x.py"]),
    (D.SECRET_HINT, ["PASSWORD = x", "api-key: y", "private_key", "Bearer z"], ["x = 1", "passage"]),
    (D.QUOTED_TOKEN, ['k = "abcdefghij0123456789"', "k = 'abcdefghij!123456789'"], ['"abcdefghij 123456789 x"', "'abcdefghij0123456789\"", '"short"']),
    (D.LOOP_HEAD, ["for a in b:", "    while x:  # y", "async for a in b:"], ["for_a = b", "if a:"]),
    (D.LOOP_CONCAT, ["    s += 'x'", '\ts.t += f"x"'], ["s += 'x'", "    s += 1"]),
]
PROVIDED = {
    "AWS Secret Key": ('aws_secret = "abcdefghijABCDEFGHIJ0123456789abcdefgh/+"', 'aws_secret = "short"'),
    "Generic API Secret": ("client_secret: 'abcdefgh12345678'", "client_secret: 'short'"),
    "Database URL": ("x = mysql://root:pw@host/db", "x = mysql://host/db"),
}


@pytest.mark.parametrize("name", [a[0] for a in D.ANTIPATTERNS])
def test_antipatterns(name):
    pattern = {a[0]: a[3] for a in D.ANTIPATTERNS}[name]
    good, bad = ANTIPATTERNS[name]
    assert all(re.search(pattern, x) for x in good) and not any(re.search(pattern, x) for x in bad)


@pytest.mark.parametrize("pattern, good, bad", EXPRESSIONS)
def test_expressions(pattern, good, bad):
    assert [x for x in good if not re.search(pattern, x)] == [] and [x for x in bad if re.search(pattern, x)] == []


@pytest.mark.parametrize("name", sorted(PROVIDED))
def test_named_keys(name):
    pattern = {p[0]: p[2] for p in D.PROVIDERS}[name]
    good, bad = PROVIDED[name]
    assert re.search(pattern, good) and not re.search(pattern, bad)


def test_time_on_a_long_line():
    import time

    for p in [*(a[3] for a in D.ANTIPATTERNS), *(p[2] for p in D.PROVIDERS), *(e[0] for e in EXPRESSIONS)]:
        for line in ("A" * 50_000, "x = " + "a, " * 700, "def f(" + "a=" * 900, " if a else" * 190):
            began = time.perf_counter()
            re.search(p, line[:2000] if " " in line else line)
            assert time.perf_counter() - began < 0.3, p
