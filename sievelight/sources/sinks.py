"""Sinks: findings as text, problem-matcher lines, JSON, SARIF and report rows. Rows are formatted where they are; only an envelope is put around them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from .document import write_document


def text_lines(found: DataFrame) -> DataFrame:
    """path, seq, line: a header for each file and a line for each of its findings."""
    head = found.groupBy("path").agg(F.count("*").alias("n")).select("path", F.lit(-1).cast("long").alias("seq"), F.concat("path", F.lit(": "), F.col("n").cast("string"), F.lit(" findings")).alias("line"))
    body = found.select("path", "seq", F.format_string("  [%s] line %d: %s (%s)", F.upper("severity"), "line_no", "rule_id", "cwe").alias("line"))
    return head.unionByName(body)


def problem_lines(found: DataFrame) -> DataFrame:
    """path:line:col: level: title [cwe] (severity)"""
    level = dims.mapped("severity", {"critical": "error", "high": "error", "medium": "warning", "low": "info", "info": "info"}, "info")
    return found.select(F.format_string("%s:%d:%d: %s: %s [%s] (%s)", "path", "line_no", F.greatest(F.lit(1), F.col("col")), level, "title", "cwe", "severity").alias("line"))


def json_rows(found: DataFrame) -> DataFrame:
    """path, json: each file's findings as one array; a file's findings are a bounded group."""
    one = F.struct("line_no", "rule_id", "severity", "cwe", "category", "confidence", "source")
    return found.groupBy("path").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("json"))


def sarif_rules(found: DataFrame) -> DataFrame:
    """A rule object for each rule id, from its first finding; partial aggregates leave one row a rule and task to shuffle."""
    first = F.min(F.struct("path", "line_no", "col", "title", "severity")).alias("x")
    own = found.groupBy("rule_id").agg(first).select("rule_id", "x.title", "x.severity")
    return own.select("rule_id", T.pascal_case("title").alias("name"), dims.mapped("severity", {k: v[2] for k, v in dims.SEVERITIES.items()}, "note").alias("level"), dims.mapped("severity", {k: v[3] for k, v in dims.SEVERITIES.items()}, "0.0").alias("security_severity"))


def sarif_results(found: DataFrame) -> DataFrame:
    """rule_id and the result object as JSON."""
    uri = F.replace("path", F.lit("\\"), F.lit("/"))
    region = F.struct(F.col("line_no").alias("startLine"), F.when(F.col("col") == 0, 1).otherwise(F.col("col") + 1).cast("long").alias("startColumn"), F.struct(F.col("snippet").alias("text")).alias("snippet"))
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    level = dims.mapped("severity", {k: v[2] for k, v in dims.SEVERITIES.items()}, "note")
    body = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), place.alias("locations"), F.struct(T.fingerprint("rule_id", "path", "snippet").alias("primary")).alias("fingerprints"))
    return found.select("rule_id", "path", "line_no", F.to_json(body).alias("result"))


def sarif_frame(found: DataFrame, ended: str) -> tuple[str, str]:
    """What stands before and after the results: the rules, of the catalog's number, and the run."""
    rules = [{"id": r.rule_id, "name": r.name, "defaultConfiguration": {"level": r.level}, "properties": {"security-severity": r.security_severity}} for r in sarif_rules(found).orderBy("rule_id").toLocalIterator()]
    tool = json.dumps({"driver": {"name": "sievelight", "rules": rules}})
    run = json.dumps([{"executionSuccessful": True, "endTimeUtc": ended}])
    return f'{{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{{"tool": {tool}, "invocations": {run}, "results": [\n', "\n]}]}\n"


def _ordered_results(found: DataFrame) -> DataFrame:
    return sarif_results(found).orderBy("path", "line_no", "rule_id", "result").select("result")


def write_sarif(found: DataFrame, path: str, ended: str) -> None:
    """The SARIF document as one file, a result a line, written by all tasks."""
    head, tail = sarif_frame(found, ended)
    write_document(_ordered_results(found), path, head, tail, ",\n")


def sarif_document(found: DataFrame, ended: str) -> str:
    """The whole document as one text, for reports that fit the driver."""
    head, tail = sarif_frame(found, ended)
    return head + ",\n".join(r.result for r in _ordered_results(found).toLocalIterator()) + tail


def write_baseline(fingerprints: DataFrame, path: str) -> None:
    """A baseline (fingerprint) as one JSON document: version, count, and the sorted fingerprints."""
    own = fingerprints.select("fingerprint").where("fingerprint is not null").distinct()
    quoted = own.orderBy("fingerprint").select(F.to_json(F.struct("fingerprint")).alias("j")).select(F.expr("substring(j, 16, length(j) - 16)"))
    write_document(quoted, path, f'{{"version": 1, "count": {own.count()}, "fingerprints": [\n', "\n]}\n", ",\n")


def write_json(found: DataFrame, path: str) -> None:
    """A JSON array of each file's findings, a file a line."""
    write_document(json_rows(found).orderBy("path").select("json"), path, "[\n", "\n]\n", ",\n")


def write_html(found: DataFrame, path: str) -> None:
    write_document(report_rows(found).select("html"), path, "<table>\n", "\n</table>\n")


def write_lines(lines: DataFrame, path: str, tail: str = "") -> None:
    """Lines in the frame's order as one text file."""
    write_document(lines, path, "", "\n" + tail)


def rule_help(catalog: DataFrame) -> DataFrame:
    return catalog.select("rule_id", F.concat_ws("\n", "title", F.concat(F.lit("Weakness: "), "cwe"), F.concat(F.lit("Class: "), "owasp"), F.concat(F.lit("Severity: "), "severity")).alias("help"))


def report_rows(found: DataFrame) -> DataFrame:
    """HTML table rows in the report's order."""
    cell = lambda c: F.concat(F.lit("<td>"), T.html_escape(F.col(c).cast("string")), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *[cell(c) for c in ("severity", "path", "line_no", "rule_id", "snippet")], F.lit("</tr>"))
    return found.orderBy(dims.rank("severity"), "path", "line_no", "rule_id").select("path", "line_no", "rule_id", row.alias("html"))


def ide_union(found: DataFrame, anti: DataFrame, functions: DataFrame) -> DataFrame:
    """Findings, anti-patterns and complex functions as one list."""
    issue = functions.where("n_issues > 0").select("path", F.col("line").alias("line_no"), F.lit("COMPLEXITY").alias("rule_id"), F.when(F.col("refactor_priority") == "high", "medium").otherwise("low").alias("severity"), F.lit("complexity").alias("kind"))
    one = found.select("path", "line_no", "rule_id", "severity", F.lit("finding").alias("kind"))
    return one.unionByName(anti.select("path", "line_no", "rule_id", "severity", F.lit("antipattern").alias("kind"))).unionByName(issue)


def explained(overview: DataFrame, functions: DataFrame) -> DataFrame:
    """path, json: each file's overview (`syntax.explain_files`) with what is told of its functions (`syntax.describe_functions`); a file's functions are a bounded group."""
    own = functions.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("function", "params", "returns", "raises", "calls"))).alias("own"))
    names = lambda c: F.filter(F.split(c, ","), lambda x: x != "").alias(c)
    body = F.struct("path", "purpose", "loc", "functions", "classes", "imports", names("import_names"), names("function_names"), F.coalesce("own", F.array()).alias("described"))
    return overview.join(own, "path", "left").select("path", F.to_json(body).alias("json"))


def write_explained(own: DataFrame, path: str) -> None:
    write_document(own.orderBy("path").select("json"), path, "[\n", "\n]\n", ",\n")


def write_text(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
