"""The pipeline's stages, each against what it must do to its own input."""

import re

import corpus_pipeline as P
from sievelight.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = common.table(spark, SF, "documents")
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == common.table(spark, SF, "documents").columns
    language, dedup, secret, mix, packed = (seen[n] for n, _ in P.STAGES)
    assert dedup.count() == dedup.select("doc_id").distinct().count() <= language.count()
    assert secret.count() == dedup.count() and not [r for r in secret.select("text").collect() if re.search(r'token = "[0-9a-f]{40}"|password=[0-9a-f]{18}|AKIA[0-9A-Z]{16}', r.text)]
    assert mix.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    assert packed.where("start = 0").count() == mix.count()


def test_stages_with_odd_rows(spark, edge_rows, empty, tmp_path):
    for i, docs in enumerate((spark.createDataFrame(edge_rows, empty.schema), empty)):
        for name, stage in P.STAGES:
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{i}{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{i}{name}"))
