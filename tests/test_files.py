"""The pruned folder source and the document sink: what is listed and read, one valid document, nothing left of a failed job."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sievelight import __main__ as cli
from sievelight.sources import document, files, folder, sinks


def tree(top, rows):
    for name, text in rows.items():
        p = top / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


ROWS = {
    "a.py": "x = 1", "b.PY": "y", "sub/pom.xml": "<p/>", "sub/deep/c.js": "z" * 100, "notes.txt": "no", ".py": "hidden name, no suffix", "node_modules/m.js": "m", "sub/.git/g.py": "g", "vendor/v.py": "v", "vendor/in/w.py": "w",
    "gen/one.gen.py": "g", "empty.py": "", "bad.py": b"ok \xff\xfe \xc3\xbc", "odd [1]{x}*.py": "odd",
}
KEPT = {"a.py", "b.PY", "sub/pom.xml", "sub/deep/c.js", "vendor/v.py", "vendor/in/w.py", "gen/one.gen.py", "empty.py", "bad.py", "odd [1]{x}*.py"}


def names(df, top):
    return {r.path.split(str(top) + "/", 1)[1] for r in df.select("path").collect()}


def test_only_what_is_wanted_is_listed_and_read(spark, tmp_path):
    tree(tmp_path, ROWS)
    os.mkfifo(tmp_path / "node_modules" / "pipe.py")  # whoever opened it would wait for ever
    with open(tmp_path / "clip.mp4", "wb") as f:
        f.truncate(3 << 30)  # above what one row can hold
    os.symlink(tmp_path, tmp_path / "sub" / "circle")
    own = files.read_files(spark, str(tmp_path))
    assert names(own, tmp_path) == KEPT
    text = {r.path.rsplit("/", 1)[1]: r.text for r in own.collect()}
    assert text["bad.py"] == "ok  ü" and text["empty.py"] == "" and text["c.js"] == "z" * 100
    # The same from a store that only Spark opens, and with globs that prune whole folders or single files.
    assert names(files.read_files(spark, f"{tmp_path}/{{sub,gen}}"), tmp_path) == {"sub/pom.xml", "sub/deep/c.js", "gen/one.gen.py"}
    assert names(files.read_files(spark, str(tmp_path), ignore=("vendor/*", "*.gen.py")), tmp_path) == KEPT - {"vendor/v.py", "vendor/in/w.py", "gen/one.gen.py"}
    assert sorted(p.split(str(tmp_path) + "/")[1] for p, _ in folder.listed(spark, str(tmp_path), folder.Rules(("vendor/*",)))) == sorted(KEPT - {"vendor/v.py", "vendor/in/w.py"})
    assert names(files.read_files(spark, str(tmp_path), recursive=False), tmp_path) == {x for x in KEPT if "/" not in x}


def test_folders_are_pruned_before_they_are_listed(tmp_path, monkeypatch):
    tree(tmp_path, ROWS)
    seen = []
    selector = folder.fs.FileSelector
    monkeypatch.setattr(folder.fs, "FileSelector", lambda path, **k: seen.append(path) or selector(path, **k))
    reader = folder.FolderReader({"path": str(tmp_path), "ignore": '["vendor/*"]'})
    parts = reader.partitions()
    assert {os.path.relpath(x, tmp_path) for x in seen} == {".", "sub", "sub/deep", "gen"}
    # The bytes that tasks read are those of the files kept.
    kept = [x for p in parts for x in p.files]
    assert sum(n for _, n in kept) == sum(len(b["content"][0].as_py()) for p in parts for b in ({"content": [c]} for r in reader.read(p) for c in r.column("content")))


def test_files_are_dealt_by_bytes(spark, tmp_path):
    sizes = [1, 5 << 20, 3, 40 << 20, 7, 9 << 20]
    parts = folder.dealt(iter((str(i), n) for i, n in enumerate(sizes)), 8 << 20)
    assert [[n for _, n in p.files] for p in parts] == [[1, 5 << 20, 3], [40 << 20], [7], [9 << 20]]
    assert folder.dealt(iter([]), 1) == []
    tree(tmp_path, {"large.py": "x" * 100, "small.py": "y"})
    for target in (str(tmp_path), f"{tmp_path}/*"):
        assert {r.path.rsplit("/", 1)[1]: r.text for r in files.read_files(spark, target, max_bytes=50).collect()} == {"large.py": None, "small.py": "y"}
    empty = tmp_path / "none"
    empty.mkdir()
    assert files.read_files(spark, str(empty)).count() == 0
    with pytest.raises(Exception, match="gone"):
        files.read_files(spark, str(tmp_path / "gone")).count()


def test_document_is_whole_and_in_order(spark, tmp_path):
    path = tmp_path / "out" / "doc.json"
    path.parent.mkdir()
    df = spark.range(5000, numPartitions=9).orderBy(F.desc("id"))
    document.write_document(df.select(F.to_json(F.struct("id"))), str(path), "[", "]", ",")
    assert [x["id"] for x in json.loads(path.read_text())] == list(range(4999, -1, -1))
    document.write_document(df.where("id % 2500 = 7").select(F.to_json(F.struct("id"))), str(path), "[", "]", ",")  # most partitions are empty
    assert json.loads(path.read_text()) == [{"id": 2507}, {"id": 7}]
    document.write_document(df.where("id < 0").select(F.lit("x")), str(path), "[", "]", ",")
    assert path.read_text() == "[]" and os.listdir(path.parent) == ["doc.json"]


def test_a_failed_job_leaves_the_old_document_alone(spark, tmp_path):
    path = tmp_path / "doc.txt"
    path.write_text("old")
    bad = spark.range(100, numPartitions=5).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception, match="no"):
        document.write_document(bad, str(path))
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["doc.txt"]


def test_command_line_writes_by_tasks(spark, tmp_path, capsys):
    top = tmp_path / "src"
    tree(top, {"a.py": "eval(x)\n", "b.py": "y = 1\n"})
    for kind in ("sarif", "json", "html", "text", "problem"):
        out = tmp_path / f"report.{kind}"
        assert cli.main([str(top), "-f", kind, "-o", str(out), "--compliance", "PCI_DSS", "--fail-on", "high"]) == 1
        assert cli.main([str(top), "-f", kind, "--fail-on", "high"]) == 1
        shown = capsys.readouterr().out
        text = out.read_text()
        if kind == "sarif":
            assert json.loads(text)["runs"][0]["results"][0]["ruleId"] == "INJ-EVAL-001" == json.loads(shown[shown.index("{") :])["runs"][0]["results"][0]["ruleId"]
        elif kind == "json":
            assert json.loads(text)[0][0]["rule_id"] == "INJ-EVAL-001" == json.loads(shown[shown.index("[\n") :])[0][0]["rule_id"]
        else:
            assert ("INJ-EVAL-001" in text or "eval" in text) and ("PCI_DSS" in text) == (kind in ("text", "problem"))
    assert sorted(os.listdir(tmp_path)) == ["report.html", "report.json", "report.problem", "report.sarif", "report.text", "src"]
