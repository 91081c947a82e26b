"""Findings as a relation: union of detectors, merging, confirmation, deduplication, scores, suppression, compliance.

A finding has path, line_no, rule_id, severity, cwe, category, snippet, confidence, source, `seq`, which states the order in
which detectors and rules count when the first one wins, and `flow`, the way of tainted data, null elsewhere. Each step is a join or a window on (path, line_no), so
a scan shuffles its findings, never its files, and all steps share that partitioning.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from .catalog import CURRENT
from .fixpoint import shared_dir

COLUMNS = ("path", "line_no", "rule_id", "severity", "cwe", "category", "snippet", "confidence", "source", "seq", "flow")
#: The order of detectors.
DETECTORS = {"taint": 0, "rule": 1, "dataflow": 2, "secret-scanner": 3, "entropy": 4}


def union_detectors(*found: DataFrame) -> DataFrame:
    """All detectors' findings with their `seq`: detector first, then rule."""
    parts = []
    for df in found:
        own = F.col("rule_seq") if "rule_seq" in df.columns else F.lit(0)
        seq = dims.mapped("source", DETECTORS, 9) * 1000 + own
        df = df if "flow" in df.columns else df.withColumn("flow", F.lit(None).cast("string"))
        parts.append(df.withColumn("seq", seq.cast("long")).select(*COLUMNS))
    return reduce(DataFrame.unionByName, parts)


def _any(cond: Column, *keys: str) -> Column:
    """Whether a row of the same keys meets the condition: a window, so that the findings are read once and shuffled once."""
    return F.coalesce(F.bool_or(cond).over(Window.partitionBy(*keys)), F.lit(False))


def merge_taint_over_rule(found: DataFrame, same_cwe: bool = False) -> DataFrame:
    """Taint findings replace rule findings of their line (with `same_cwe`, of their line and weakness) and are confirmed by them."""
    keys, source = ["path", "line_no"] + ["cwe"] * same_cwe, F.col("source")
    own = found.withColumn("_rule", _any(source == "rule", *keys)).withColumn("_taint", _any(source == "taint", *keys)).where(~(F.col("_taint") & (source == "rule")))
    return own.withColumn("confidence", F.when((source == "taint") & F.col("_rule"), "confirmed").otherwise(F.col("confidence"))).select(found.columns)


def merge_dataflow(found: DataFrame) -> DataFrame:
    """Data-flow findings stay only where no other one has their line and weakness."""
    flow = F.col("source") == "dataflow"
    return found.withColumn("_other", _any(~flow, "path", "line_no", "cwe")).where(~(F.col("_other") & flow)).drop("_other")


def merge_secrets(found: DataFrame) -> DataFrame:
    """Secrets stay only on lines without a finding of the category `secrets` from another detector."""
    secret = F.col("source").isin("secret-scanner", "entropy")
    return found.withColumn("_other", _any(~secret & (F.col("category") == "secrets"), "path", "line_no")).where(~(F.col("_other") & secret)).drop("_other")


def confirm_multi_source(found: DataFrame) -> DataFrame:
    """Findings of a weakness on a line that two detectors and more report are confirmed."""
    w = Window.partitionBy("path", "line_no", "cwe")
    return found.withColumn("_n", F.size(F.collect_set("source").over(w))).withColumn("confidence", F.when(F.col("_n") >= 2, "confirmed").otherwise(F.col("confidence"))).drop("_n")


def dedupe(found: DataFrame) -> DataFrame:
    """The first finding of each line, weakness and category, with the ids of all of them."""
    w = Window.partitionBy("path", "line_no", "cwe", "category")
    first = F.row_number().over(w.orderBy("seq", "rule_id"))
    ids = F.array_join(F.array_sort(F.collect_set("rule_id").over(w)), ",")
    return found.withColumn("rule_ids", ids).withColumn("_first", first).where("_first = 1").drop("_first")


def _order() -> list:
    return [dims.rank("severity"), F.col("path"), F.col("line_no"), F.col("seq"), F.col("rule_id")]


def sort_findings(found: DataFrame) -> DataFrame:
    """All findings, the gravest first, then by place and detector."""
    return found.orderBy(*_order())


def placed(found: DataFrame) -> DataFrame:
    """All findings with their `place` from 1 in the order of `sort_findings`, equal ones in any order.

    Ranges of the order are written to the shared folder, each sorted and numbered by itself; the ranges' counts, a row for each
    partition, give each its first place. No task reads more than a range, and ranges are drawn once, so counts and rows agree.
    """
    spark = found.sparkSession
    root = f"{shared_dir(spark)}/placed-{uuid.uuid4().hex}"
    ranges = found.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    part = F.spark_partition_id()
    ranges.withColumn("_part", part).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).write.parquet(root)
    own = spark.read.parquet(root)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(counts), "_part").select((F.col("_before") + F.col("_in") + 1).alias("place"), *found.columns)


def merged(*found: DataFrame) -> DataFrame:
    """The whole chain, in one shuffle by (path, line_no): the detectors are read once, and every step is a window on it.

    Sources that agree confirm each other first; taint then replaces rules of its line and weakness, data flow gives way
    to any other source of its line and weakness, secrets to others' secrets of their line; the first of the rest stays.
    """
    line = Window.partitionBy("path", "line_no")
    weakness = Window.partitionBy("path", "line_no", "cwe")
    some = lambda cond, w: F.coalesce(F.max(cond).over(w), F.lit(False))
    source, secret = F.col("source"), F.col("source").isin("secret-scanner", "entropy")
    own = union_detectors(*found).repartition("path", "line_no").select(
        "*", F.size(F.collect_set("source").over(weakness)).alias("_n"), some(source == "taint", weakness).alias("_taint"), some(source != "dataflow", weakness).alias("_other")
    )
    own = own.withColumn("confidence", F.when(F.col("_n") >= 2, "confirmed").otherwise(F.col("confidence")))
    own = own.where(~(F.col("_taint") & (source == "rule")) & ~(F.col("_other") & (source == "dataflow")))
    own = own.withColumn("_secrets", some((F.col("category") == "secrets") & ~secret, line)).where(~(F.col("_secrets") & secret))
    return dedupe(own.select(*COLUMNS))


def owasp_coverage(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Findings by OWASP class, of the rules in the catalog."""
    return found.join(F.broadcast(catalog.select("rule_id", "owasp")), "rule_id").groupBy("owasp").agg(F.count("*").alias("n"))


def severity_summary(found: DataFrame) -> DataFrame:
    """A row for each file: its findings by severity and in all."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in dims.SEVERITIES]
    return found.groupBy("path").agg(*counts, F.count("*").alias("total"))


def file_score(files: DataFrame, found: DataFrame, functions: DataFrame | None = None, clones: DataFrame | None = None, anti: DataFrame | None = None) -> DataFrame:
    """Score and grade of each file of `files`: 100 less weights, complex functions, clones and grave anti-patterns."""
    parts = [found.groupBy("path").agg(F.sum(dims.weight("severity")).alias("penalty"))]
    if functions is not None:
        parts.append(functions.where("refactor_priority = 'high'").groupBy("path").agg((3 * F.count("*")).alias("penalty")))
    if clones is not None:
        parts.append(clones.groupBy("path").agg(F.count("*").alias("penalty")))
    if anti is not None:
        parts.append(anti.where("severity = 'high'").groupBy("path").agg((2 * F.count("*")).alias("penalty")))
    penalty = reduce(DataFrame.unionByName, parts).groupBy("path").agg(F.sum("penalty").alias("penalty"))
    out = files.select("path").distinct().join(penalty, "path", "left")
    score = F.greatest(F.lit(0), 100 - F.coalesce("penalty", F.lit(0))).cast("long")
    return out.select("path", score.alias("score"), T.grade(score).alias("grade"))


# Suppression --------------------------------------------------------------------------------------------------------------

MARK = r"(?i)(#|//|/\*|--|<!--)\s*(nosec|noqa:\s*sievelight|sievelight:\s*ignore)([^0-9A-Za-z_\[]|$)"
MARK_RULES = r"(?i)(?:#|//|/\*|--|<!--)\s*sievelight:\s*ignore\[([A-Za-z0-9_, -]+)\]"


def suppressions(lines: DataFrame) -> DataFrame:
    """path, line_no, rule_id of inline marks; a null rule_id stands for all rules."""
    ids = F.regexp_extract("text", MARK_RULES, 1)
    some = lines.where(F.lower("text").contains("nosec") | F.lower("text").contains("sievelight"))
    named = some.where(ids != "").select("path", "line_no", F.explode(F.split(ids, ",")).alias("rule_id"))
    now = F.create_map(*[F.lit(x) for kv in CURRENT.items() for x in kv])
    named = named.select("path", "line_no", F.coalesce(F.element_at(now, F.trim("rule_id")), F.trim("rule_id")).alias("rule_id"))
    every = some.where((ids == "") & F.col("text").rlike(MARK)).select("path", "line_no", F.lit(None).cast("string").alias("rule_id"))
    return named.unionByName(every)


def _marked(found: DataFrame, marks: DataFrame) -> DataFrame:
    """The findings with `_off`, whether an inline mark of their line holds for them: one join with a row for each marked line."""
    lines = marks.groupBy("path", "line_no").agg(F.bool_or(F.col("rule_id").isNull()).alias("_every"), F.collect_set("rule_id").alias("_ids"))
    off = F.coalesce(F.col("_every") | F.array_contains("_ids", F.col("rule_id")), F.lit(False))
    return found.join(lines, ["path", "line_no"], "left").withColumn("_off", off).drop("_every", "_ids")


def suppress_inline(found: DataFrame, marks: DataFrame) -> DataFrame:
    return _marked(found, marks).where("not _off").select(found.columns)


def suppressed_inline(found: DataFrame, marks: DataFrame) -> DataFrame:
    """The findings that inline marks take away."""
    return _marked(found, marks).where("_off").select(found.columns)


def with_fingerprint(found: DataFrame) -> DataFrame:
    return found.withColumn("fingerprint", T.fingerprint("rule_id", "path", "snippet"))


def suppress_baseline(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return with_fingerprint(found).join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def suppress_rules(found: DataFrame, rule_ids: list[str]) -> DataFrame:
    """Drops findings by rule id; former ids count as the rules that now find the same."""
    ids = [CURRENT.get(r, r) for r in rule_ids]
    return found.where(~F.col("rule_id").isin(*ids)) if ids else found


def suppress_globs(found: DataFrame, globs: list[str]) -> DataFrame:
    """Drops findings whose path matches one of the globs, which a user lists by hand."""
    cond = reduce(lambda a, b: a | b, [F.col("path").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in ".+^$(){}|\\[]" else c for c in g) + "$") for g in globs], F.lit(False))
    return found.where(~cond)


def baseline(found: DataFrame) -> DataFrame:
    """fingerprint: the distinct ones, a row each; `sinks.write_baseline` puts the envelope around them."""
    return with_fingerprint(found).select("fingerprint").distinct()


def min_severity(found: DataFrame, least: str) -> DataFrame:
    return found.where(dims.rank("severity") <= dims.SEVERITIES[least][0])


def fail_on(found: DataFrame, least: str) -> DataFrame:
    """One row: the exit code, 1 if a finding is as grave as `least`."""
    return found.agg(F.coalesce(F.max((dims.rank("severity") <= dims.SEVERITIES[least][0]).cast("int")), F.lit(0)).cast("long").alias("exit_code"))


# Compliance ---------------------------------------------------------------------------------------------------------------


def compliance(found: DataFrame, standards: list[str] | None = None) -> DataFrame:
    """A row for each control: its violations and whether it passes. Findings are counted by weakness before the join."""
    controls = dims.controls(found.sparkSession)
    if standards:
        controls = controls.where(F.col("standard").isin(*standards))
    counts = found.groupBy("cwe").agg(F.count("*").alias("n"))
    out = F.broadcast(controls).join(counts, "cwe", "left").groupBy("standard", "control_id", "level").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return out.withColumn("status", F.when(F.col("violations") > 0, "fail").otherwise("pass"))


def compliance_summary(found: DataFrame, standards: list[str] | None = None) -> DataFrame:
    own = compliance(found, standards).groupBy("standard").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed"))
    return own.select("standard", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.round(100.0 * F.col("passed") / F.col("total"), 1).alias("percent"), (F.col("total") == F.col("passed")).alias("compliant"))


# Clones -------------------------------------------------------------------------------------------------------------------


def clone_windows(lines: DataFrame, size: int = 6, key: str = "path") -> DataFrame:
    """key, line_no, block: every window of `size` lines that are not empty once normalised; a block is its lines' hash."""
    norm = lines.select(key, "line_no", T.normalise_line("text").alias("line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(0, size - 1)
    own = norm.withColumn("_lines", F.collect_list("line").over(w))
    return own.where((F.size("_lines") == size) & ~F.array_contains("_lines", "")).select(key, "line_no", F.md5(F.array_join("_lines", "\n")).alias("block"))


def clone_pairs(lines: DataFrame, size: int = 6, key: str = "path") -> DataFrame:
    """Each later window with the first one of the same block in its file."""
    first = F.min("line_no").over(Window.partitionBy(key, "block"))
    return clone_windows(lines, size, key).select(key, first.alias("first_line"), F.col("line_no").alias("duplicate_line"), F.lit(size).cast("long").alias("block_size")).where("duplicate_line > first_line")


def loc_metrics(lines: DataFrame, by_language: bool = False) -> DataFrame:
    """Lines of each file in all, of code and of comments; `#` starts a comment unless languages have their own marks."""
    mark = T.comment_prefix("language") if by_language else F.lit("#")
    t = F.trim("text")
    comment = t.startswith(mark)
    return lines.groupBy("path").agg(F.count("*").alias("total"), F.count_if((t != "") & ~comment).alias("code"), F.count_if(comment).alias("comments"))
