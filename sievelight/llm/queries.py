"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chunks, extract, langid, licenses, mixing, neardup, ogg, oracles, packing, phrases, pii, resample, secrets, shards
from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(table(spark, sf_dir, "documents"))


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_columns(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.fingerprints(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assigned(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_license_scan, op3_ogg_media, op4_minhash_near_dedup, op5_source_mixing, op6_secret_scan, op7_chunk_fingerprints, op8_language_id, op9_html_extraction, op10_pii_pseudonyms, op11_importance_resampling, op12_phrase_collocations, op13_feistel_shards)
}

ORACLES: dict[str, str] = {"op4_minhash_near_dedup": oracles.NEAR, "op11_importance_resampling": oracles.RESAMPLE, "op12_phrase_collocations": oracles.PHRASES, "op13_feistel_shards": oracles.SHARDS}
