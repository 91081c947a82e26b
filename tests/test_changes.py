"""The folder as a stream tells each change once, over restarts and failed batches; versions out of order leave the newest."""

import datetime as dt
import os

from sievelight.streaming import changes, newest, watch

AT = dt.datetime(2020, 1, 1, 1, 2, 3, 456789)


def put(top, name, text, mtime):
    p = top / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    os.utime(p, (mtime, mtime))


def run(spark, top, tmp, fail=False):
    """What one run of the stream gives out, by a sink that is idempotent by batch."""
    out = []

    def sink(df, i):
        rows = [(r.path.rsplit("/", 1)[1], r.kind, r.text) for r in df.collect()]
        if fail:
            raise RuntimeError("lost")
        out.extend(rows)

    q = changes.folder_edits(spark, str(top), str(tmp / "log"), ("vendor/*",)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp / "ck")).trigger(once=True).start()
    try:
        q.awaitTermination()
    except Exception:
        assert fail
    return sorted(out)


def test_each_change_is_told_once(spark, tmp_path):
    top = tmp_path / "code"
    for name in ("a.py", "sub/b.js", "node_modules/c.js", "vendor/d.py", "e.bin"):
        put(top, name, name, 1_000)
    assert run(spark, top, tmp_path) == [("a.py", "new", "a.py"), ("b.js", "new", "sub/b.js")]
    assert run(spark, top, tmp_path) == []
    put(top, "a.py", "again", 2_000)
    put(top, "z.sql", "z", 2_000)
    os.remove(top / "sub/b.js")
    want = [("a.py", "changed", "again"), ("b.js", "deleted", None), ("z.sql", "new", "z")]
    assert run(spark, top, tmp_path, fail=True) == []  # the batch is planned, but lost
    put(top, "late.py", "late", 3_000)
    told = run(spark, top, tmp_path)  # the same batch again, then what came after
    told += run(spark, top, tmp_path)
    assert sorted(told) == sorted([*want, ("late.py", "new", "late")])
    assert run(spark, top, tmp_path) == []
    # Differences that Spark has committed are gone, one listing is left.
    kinds = sorted(x.split("-")[0] for x in os.listdir(tmp_path / "log"))
    assert kinds.count("seen") == 1 and kinds.count("changes") <= 1


def test_differences_are_joined(tmp_path):
    top = tmp_path / "code"
    reader = changes.ChangesReader({"path": str(top), "log": str(tmp_path / "log")})
    put(top, "a.py", "1", 1)
    put(top, "b.py", "1", 1)
    assert reader.latestOffset() == {"n": 1} == reader.latestOffset()
    put(top, "a.py", "22", 2)
    os.remove(top / "b.py")
    assert reader.latestOffset() == {"n": 2}
    put(top, "b.py", "3", 3)
    # A new reader, as after a restart, goes on with the same numbers.
    reader = changes.ChangesReader({"path": str(top), "log": str(tmp_path / "log")})
    assert reader.latestOffset() == {"n": 3}
    rows = lambda a, b: sorted((p.rsplit("/", 1)[1], k, c) for part in reader.partitions({"n": a}, {"n": b}) for p, k, _, _, c in reader.read(part))
    assert rows(0, 3) == [("a.py", "new", b"22"), ("b.py", "new", b"3")]
    assert rows(1, 3) == [("a.py", "changed", b"22"), ("b.py", "changed", b"3")]
    assert rows(2, 3) == [("b.py", "new", b"3")] and rows(3, 3) == []
    reader.commit({"n": 2})
    assert rows(2, 3) == [("b.py", "new", b"3")] and not (tmp_path / "log" / "changes-2.parquet").exists()
    os.remove(top / "b.py")
    assert rows(2, 3) == [] and reader.latestOffset() == {"n": 4} and rows(3, 4) == [("b.py", "deleted", None)]


def test_newest_over_batches_and_restarts(spark, tmp_path):
    """Three batches out of order, each its own run of the query, give what the last versions of all rows are."""
    edit = lambda path, text, version: (path, "python", text, version, AT)
    batches = [
        [edit("a", "a2", 2), edit("a", "a1", 1), edit("b", "b5", 5), edit("n", "null", None)],
        [edit("a", "a1 again", 1), edit("b", "b4", 4), edit("c", "c1", 1), edit("c", "c1 too", 1), edit("n", "null again", None)],
        [edit("a", "a3", 3), edit("b", "b5 again", 5), edit("n", "n1", 1), edit(None, "nobody", 1)],
    ]
    sent = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, watch.EDITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = newest.newest(watch.edits(spark, str(tmp_path / "in")))
        writer = stream.writeStream.outputMode("update").foreachBatch(lambda df, _, i=i: sent.extend((i, r.path, r.text, r["at"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck"))
        newest.started(spark, writer.trigger(availableNow=True)).awaitTermination()
    assert {x[3] for x in sent} == {AT}
    sent = [x[:3] for x in sent]
    key = lambda x: (x[0], x[1] or "")
    assert sorted(sent, key=key) == [(0, "a", "a2"), (0, "b", "b5"), (0, "n", "null"), (1, "c", "c1 too"), (2, None, "nobody"), (2, "a", "a3"), (2, "n", "n1")]
