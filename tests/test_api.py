"""Whole scans: a folder to reports and exit codes; rules across lines."""

import json

from sievelight import __main__ as cli
from sievelight import api
from sievelight.operators.file_rules import file_rule_scan

CODE = "import os\n\ndef f():\n    q = request.args.get('a')\n    os.system(q)\n    key = eval(q)  # nosec\n    token = 'aZ3kQ9xW7bT1mN5cV8dR0pLs'\n"


def test_scan_of_a_folder(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text(CODE)
    (tmp_path / "b.js").write_text("const app = express();\napp.listen(1);\n")
    (tmp_path / "broken.py").write_text("def x(:\n")
    scan = api.analyze_path(spark, str(tmp_path))
    rows = {(r.path.rsplit("/", 1)[1], r.line_no, r.source) for r in scan.findings.collect()}
    assert ("a.py", 5, "taint") in rows and ("a.py", 7, "entropy") in rows and ("b.js", 1, "rule") in rows and not [r for r in rows if r[1] == 6]
    assert scan.errors().count() == 1 and scan.exit_code("high") == 1 and scan.exit_code(None) == 0
    scores = {r.path.rsplit("/", 1)[1]: (r.raw_score, r.score) for r in scan.scores().collect()}
    assert scores["broken.py"] == (100, 100) and scores["a.py"][0] < scores["a.py"][1] < 100
    assert scan.owasp().count() == 0 and scan.compliance().count() == 5 and scan.report().count() == scan.findings.count()

    assert cli.main([str(tmp_path), "-f", "sarif", "-o", str(tmp_path / "out.sarif"), "--fail-on", "low"]) == 1
    assert json.loads((tmp_path / "out.sarif").read_text())["version"] == "2.1.0"
    assert cli.main([str(tmp_path / "a.py"), "--compliance", "PCI_DSS"]) == 0
    assert "PCI_DSS" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "nowhere")]) == 2


def test_fix_keeps_a_copy(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = y == None\n")
    assert cli.main(["fix", str(tmp_path / "a.py")]) == 0
    assert (tmp_path / "a.py").read_text() == "x = y is None\n" and (tmp_path / "a.py.bak").read_text() == "x = y == None\n"


def test_explain(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("import os\n\ndef f(a: int = 1):\n    return g(a)\n")
    (tmp_path / "b.js").write_text("x();\n")
    (tmp_path / "c.py").write_text("x = 1\n")
    assert cli.main(["explain", str(tmp_path)]) == 0
    a, c = json.loads(capsys.readouterr().out)
    assert a["functions"] == 1 and a["import_names"] == ["os"] and a["described"] == [{"function": "f", "params": "a: int = 1", "returns": "", "raises": "", "calls": "g"}] and c["described"] == []
    assert cli.main(["explain", str(tmp_path), "-o", str(tmp_path / "out.json")]) == 0
    assert json.loads((tmp_path / "out.json").read_text()) == [a, c]
    assert cli.main(["explain", str(tmp_path / "b.js")]) == 2


def test_rules_across_lines(spark):
    rows = [("a.js", "javascript", "// top\nconst app = express();\n" + "x();\n" * 5), ("b.js", "javascript", "const app = express();\napp.use(helmet());"), ("c.java", "java", "class A {\n  @PostMapping\n  void f() {}\n @PreAuthorize @PutMapping\n}"), ("d.py", "python", "for a in b:\n    s += 'x'\n")]
    got = {(r.path, r.rule_id, r.line_no, r.col) for r in file_rule_scan(spark.createDataFrame(rows, "path string, language string, text string")).collect()}
    assert got == {("a.js", "FW-EXPRESS-002", 2, 12), ("c.java", "FW-SPRING-003", 4, 15), ("d.py", "AP-STRING-CONCAT-LOOP", 1, 0)}


def test_incremental(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    done = api.incremental(files, spark.createDataFrame([], "content_sha256 string"))
    assert done.count() == 2 and api.incremental(files, done.where("path = 'a'")).collect()[0].path == "b"
