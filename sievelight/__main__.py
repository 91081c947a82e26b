"""Command line: scans a path, writes a report, ends with 1 if a finding is as grave as asked, 2 without files."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from .functions import dims
from .operators import refactor, syntax
from .sources import files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievelight", description="Scans source code for unsafe patterns, secrets and tainted data.")
    p.add_argument("target", help="a file or folder; or `fix`, `explain` or `init`")
    p.add_argument("path", nargs="?", help="what to fix or explain, or where to begin")
    p.add_argument("-f", "--format", choices=("text", "json", "sarif", "problem", "html"), default="text")
    p.add_argument("-o", "--output")
    p.add_argument("-r", "--recursive", action="store_true")
    p.add_argument("-d", "--depth", type=int, choices=(1, 2, 3))
    p.add_argument("--fail-on", choices=tuple(dims.SEVERITIES))
    p.add_argument("--compliance", choices=("PCI_DSS", "HIPAA", "SOC2", "GDPR", "OWASP_TOP10"))
    p.add_argument("--ignore-rule", action="append")
    p.add_argument("--all", action="store_true", default=None)
    p.add_argument("--security-only", action="store_true")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--no-color", action="store_true", help="output has no colours anyway")
    p.add_argument("--watch", action="store_true")
    p.add_argument("--level", type=int, choices=(1, 2, 3), default=1)
    p.add_argument("--version", action="version", version="0.1")
    return p


def find_config(start: Path) -> str | None:
    """The first options file from `start` up, not above a repository's root."""
    for folder in (start, *start.parents):
        if (f := folder / files.CONFIG_NAME).is_file():
            return f.read_text(errors="ignore")
        if (folder / ".git").exists():
            break
    return None


def text_report(scan: api.Scan) -> DataFrame:
    """line: files and their findings in order, then, if asked for, what is no finding."""
    own = sinks.text_lines(scan.findings).select(F.lit(0).alias("_kind"), "path", "seq", "line")
    if scan.options.quality:
        other = scan.report().where("kind <> 'finding'")
        line = F.format_string("  [%s] %s:%d %s", "severity", "path", "line_no", "rule_id")
        own = own.unionByName(other.select(F.lit(1).alias("_kind"), "path", F.col("line_no").cast("long").alias("seq"), line.alias("line")))
    return own.orderBy("_kind", "path", "seq", "line").select("line")


def rendered(scan: api.Scan, kind: str, ended: str) -> Iterator[str]:
    """The report's lines one by one, for a terminal."""
    own = scan.findings
    if kind == "sarif":
        yield sinks.sarif_document(_shown(scan), ended)
        return
    ordered = {
        "json": lambda: sinks.json_rows(own).orderBy("path").select("json"),
        "problem": lambda: sinks.problem_lines(_shown(scan)).orderBy("line"),
        "html": lambda: sinks.report_rows(own).select("html"),
        "text": lambda: text_report(scan),
    }[kind]()
    head, between, tail = {"json": ("[", ",", "]"), "html": ("<table>", "", "</table>")}.get(kind, ("", "", ""))
    if head:
        yield head
    last = None
    for row in ordered.toLocalIterator():
        if last is not None:
            yield last + between
        last = row[0]
    if last is not None:
        yield last
    if tail:
        yield tail


def written(scan: api.Scan, kind: str, ended: str, path: str, more: list[str]) -> None:
    """The report as one file, by the tasks; `more` are lines after a text report."""
    if kind == "sarif":
        sinks.write_sarif(_shown(scan), path, ended)
    elif kind == "json":
        sinks.write_json(scan.findings, path)
    elif kind == "html":
        sinks.write_html(scan.findings, path)
    else:
        lines = text_report(scan) if kind == "text" else sinks.problem_lines(_shown(scan)).orderBy("line")
        sinks.write_lines(lines, path, "".join(x + "\n" for x in more))


def _shown(scan: api.Scan):
    titles = scan.options.catalog.table(scan.files.sparkSession).select("rule_id", "title")
    return scan.findings.join(F.broadcast(titles), "rule_id", "left").withColumn("title", F.coalesce("title", "rule_id")).withColumn("col", F.lit(0))


def fix(spark, path: str, level: int) -> int:
    """Writes each rewritten Python file beside a copy of the old one."""
    changed = 0
    source = files.read_files(spark, path)
    for r in refactor.refactored(source, level).join(source.withColumnRenamed("text", "old").select("path", "old"), "path").where("text <> old").toLocalIterator():
        f = Path(r.path.removeprefix("file:"))
        f.with_suffix(f.suffix + ".bak").write_text(r.old)
        f.write_text(r.text)
        changed += 1
    print(f"{changed} files changed")
    return 0


def explain(spark, path: str, output: str | None) -> int:
    """A JSON array with an overview of each Python file and its functions; 2 without such files."""
    facts = syntax.facts(files.read_files(spark, path)).persist()
    own = sinks.explained(syntax.explain_files(facts), syntax.describe_functions(facts))
    empty = own.isEmpty()
    if empty:
        print("no files", file=sys.stderr)
    elif output:
        sinks.write_explained(own, str(Path(output).resolve()))
    else:
        between = "["
        for row in own.orderBy("path").select("json").toLocalIterator():
            print(between + row.json)
            between = ","
        print("]")
    facts.unpersist()
    return 2 if empty else 0


def main(argv: list[str] | None = None) -> int:
    import datetime as dt

    from pyspark.sql import SparkSession

    a = parser().parse_args(argv)
    if a.target == "init":
        (Path(a.path or ".") / files.CONFIG_NAME).write_text('{"depth": 2, "all": false, "ignore_rule": [], "fail_on": null}\n')
        return 0
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if a.target == "fix":
        return fix(spark, a.path, a.level)
    if a.target == "explain":
        return explain(spark, str(Path(a.path or ".").resolve()), a.output)
    target = Path(a.target)
    if not target.exists():
        print(f"{target}: not found", file=sys.stderr)
        return 2
    o = files.merge_config({"depth": a.depth, "all": a.all, "ignore_rule": a.ignore_rule, "fail_on": a.fail_on}, find_config(target.resolve().parent if target.is_file() else target.resolve()))
    while True:
        scan = api.analyze_path(spark, str(target.resolve()), api.Options(o["depth"], tuple(o["ignore_rule"]), (), bool(o["all"]) and not a.security_only), a.recursive or target.is_dir())
        scan.files = scan.files.cache()
        if scan.files.isEmpty():
            print("no files", file=sys.stderr)
            return 2
        ended, more = dt.datetime.now(dt.timezone.utc).isoformat(), []
        if a.compliance:
            more = [f"{r.standard}: {r.percent}% ({r.passed} of {r.total})" for r in scan.compliance([a.compliance]).collect()]
        if a.output:
            written(scan, a.format, ended, str(Path(a.output).resolve()), more)
        if not a.quiet:
            for line in [*more] if a.output else chain(rendered(scan, a.format, ended), more):
                print(line)
        if not a.watch:
            return scan.exit_code(o["fail_on"])
        _wait_for_change(target)


def _wait_for_change(target: Path) -> None:
    import time

    seen = lambda: {p: p.stat().st_mtime for p in target.rglob("*") if p.is_file()}
    before = seen()
    while seen() == before:
        time.sleep(1)


if __name__ == "__main__":
    sys.exit(main())
