"""The stream finds what the batch finds; bursts of edits leave their last version."""

import datetime as dt

from sievelight.operators.detect import rule_scan
from sievelight.sources.files import to_lines
from sievelight.streaming import watch as W

AT = dt.datetime(2020, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"f{i}.py", "python", f"x = 1\neval(a{i})" if i % 2 else "ok()", 1, AT) for i in range(6)]
    df = spark.createDataFrame(rows, W.EDITS)
    df.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    W.watch(W.edits(spark, str(tmp_path / "in")), lambda found, i: found.write.mode("overwrite").parquet(f"{out}/batch={i}"), str(tmp_path / "ck")).awaitTermination()
    key = lambda f: sorted((r.path, r.line_no, r.rule_id) for r in f.collect())
    assert key(spark.read.parquet(out)) == key(rule_scan(to_lines(df)))


def test_latest_and_debounce(spark, tmp_path):
    at = lambda s: AT + dt.timedelta(seconds=s)
    rows = [("a.py", "python", "one", 1, at(0)), ("a.py", "python", "two", 2, at(0.3)), ("a.py", "python", "three", 3, at(20)), ("b.py", "python", "b", 1, at(100))]
    df = spark.createDataFrame(rows, W.EDITS)
    assert sorted((r.path, r.text) for r in W.latest_only(df).collect()) == [("a.py", "three"), ("b.py", "b")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = W.debounced(W.edits(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("burst").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.text for r in spark.table("burst").collect()) == ["three", "two"]
