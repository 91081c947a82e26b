"""Sources: folders of source files, project options, baselines, ignore files, and snapshots of a folder."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from . import folder, stores

CONFIG_NAME = ".sievelightrc"


def keep_path(path: str = "path", below: Column | str = ""):
    """Whether a scan reads the path: a known suffix or build file, in no skipped folder below `below`, which is the path's beginning."""
    known = T.suffix(path).isin(*dims.SUFFIXES) | F.lower(T.file_name(path)).isin(*dims.BUILD_FILES)
    inner = F.substring(F.col(path), F.length(F.lit(below) if isinstance(below, str) else below) + 1, F.length(path))
    return known & ~F.arrays_overlap(F.split(inner, "/"), F.array(*map(F.lit, dims.SKIPPED_DIRS)))


def clean_text(content: Column | str) -> Column:
    """Bytes as text; those that aren't UTF-8 are left out."""
    return F.replace(F.make_valid_utf8((F.col(content) if isinstance(content, str) else content).cast("string")), F.lit("\ufffd"), F.lit(""))


def read_files(spark: SparkSession, target: str, recursive: bool = True, ignore: tuple[str, ...] = (), max_bytes: int = folder.MAX_BYTES) -> DataFrame:
    """path, language, text of the source files below `target`, or of the file itself, whatever its suffix. Skipped folders count below the
    target only; they and what the globs `ignore` name (of paths below the target) are neither listed nor read. Bytes that aren't UTF-8
    are left out. A file above `max_bytes` has a null text."""
    if stores.is_local(target) and not re.search(r"[*?{\[]", target):
        spark.dataSource.register(folder.PrunedFolder)
        options = {"ignore": json.dumps(list(ignore)), "recursive": str(recursive), "max_bytes": str(max_bytes)}
        raw = spark.read.format("pruned_folder").options(**options).load(target)
    else:
        found = folder.listed(spark, target, folder.Rules(tuple(ignore), recursive))
        small, large = [p for p, n in found if n <= max_bytes], [(p, n, None) for p, n in found if n > max_bytes]
        raw = spark.createDataFrame(large, folder.SCHEMA)
        if small:
            # A name may hold what a glob would read otherwise.
            names = [re.sub(r"([*?{}\[\]\\])", r"\\\1", p) for p in small]
            raw = spark.read.format("binaryFile").load(names).select("path", F.col("length").alias("size"), "content").union(raw)
    return raw.select("path", T.detect_language("path").alias("language"), clean_text("content").alias("text"))


def to_lines(files: DataFrame) -> DataFrame:
    """path, language, line_no, text; line numbers count line feeds."""
    return files.select("path", "language", F.posexplode(F.split("text", "\n", -1)).alias("_pos", "text")).select("path", "language", (F.col("_pos") + 1).cast("long").alias("line_no"), "text")


def merge_config(cli: dict, config: dict | str | None) -> dict:
    """Options: the command line wins, lists are joined, a file that can't be read counts as empty."""
    if isinstance(config, str):
        try:
            config = json.loads(config)
        except ValueError:
            config = {}
    config = config if isinstance(config, dict) else {}
    out = {"depth": 2, "all": False, "ignore_rule": [], "fail_on": None}
    for k in out:
        if isinstance(out[k], list):
            out[k] = [*config.get(k, []), *(cli.get(k) or [])]
        else:
            out[k] = cli[k] if cli.get(k) is not None else config.get(k, out[k])
    return out


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint; a baseline that isn't there or can't be read is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "fingerprint string")
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "version int, fingerprints array<string>, count long")
    return raw.select(F.explode(parsed.fingerprints).alias("fingerprint")).where("fingerprint is not null").distinct()


def parse_ignore(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rule_id, glob) relations of an ignore file's lines `value`."""
    t = F.trim("value")
    own = lines.select(t.alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    rules = own.where(F.col("value").startswith("rule:")).select(F.trim(F.substring("value", 6, 1 << 20)).alias("rule_id"))
    return rules, own.where(~F.col("value").startswith("rule:")).select(F.col("value").alias("glob"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of (path, mtime) `new` that are new or have another time; those that went are not told."""
    before = old.select("path", F.col("mtime").alias("_before"))
    return new.join(before, "path", "left").where(~F.col("mtime").eqNullSafe(F.col("_before"))).select("path", "mtime")
