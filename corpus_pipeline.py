"""A corpus pipeline: documents in a known language, one of each group of near copies, without secrets, in the
target proportions of sources, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; it returns the columns of
`documents`, the last one the pieces. `run` writes each stage's result as Parquet in the shared folder and reads
it again. Nulls, empty and repeated rows: as the operators define; a row without an id is never taken for a copy.
No SQL gives these rows (trained models, signatures, seeded selections, a tokenizer), so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import langid, mixing, neardup, packing, secrets
from sievelight.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those that the model rejects go."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where("accepted").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Of rows with equal id and text one stays, the least in its other
    columns; rows with equal id and different texts are one document in parts, and stay or go together."""
    kept = neardup.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    own = docs.join(kept.hint("shuffle_hash"), docs.doc_id == kept._id, "left_semi")
    one = own.groupBy("doc_id", F.md5("text").alias("_text")).agg(F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return one.union(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in the place of each secret."""
    return secrets.redact(docs).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; those that it doesn't take go. Rows of equal id and source are taken alike."""
    taken = mixing.mix(docs.select("doc_id", "text", "source")).where("times > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "times")
    some = taken.groupBy("_id", "_source").agg(F.max("times").alias("times"))
    same = docs.doc_id.eqNullSafe(some._id) & docs.source.eqNullSafe(some._source)
    own = docs.join(some.hint("shuffle_hash"), same)
    return own.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select([docs[c] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
