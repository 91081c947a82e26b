"""The library's surface: a whole scan of a folder or a table of files, and what is made of it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dims
from .operators import detect, findings, syntax
from .operators.catalog import Catalog
from .operators.file_rules import file_rule_scan, file_scan
from .sources import files as F_
from .sources import sinks


@dataclass
class Options:
    depth: int = 2
    ignore_rules: tuple[str, ...] = ()
    ignore_globs: tuple[str, ...] = ()
    quality: bool = False
    catalog: Catalog = field(default_factory=Catalog)


@dataclass
class Scan:
    """A scan's relations, plans but for taint and data flow, whose rounds run when findings are first asked for. Syntax facts and merged findings are kept once made, as
    much as memory and disk allow, until `release`. Anti-patterns and complex functions count for scores always, and are listed only with `quality`."""

    files: DataFrame
    options: Options
    baseline: DataFrame | None = None

    @cached_property
    def lines(self) -> DataFrame:
        return F_.to_lines(self.files)

    @cached_property
    def facts(self) -> DataFrame:
        return syntax.facts(self.files).persist()

    @cached_property
    def raw_findings(self) -> DataFrame:
        o = self.options
        parts = [syntax.taint_findings(self.facts), file_scan(self.files, o.catalog, o.depth), file_rule_scan(self.files), detect.secret_providers(self.lines), detect.secret_entropy(self.lines)]
        if o.depth >= 2:
            parts.append(syntax.dataflow_findings(self.facts))
        return findings.merged(*parts).persist()

    @cached_property
    def findings(self) -> DataFrame:
        o = self.options
        own = findings.suppress_inline(self.raw_findings, findings.suppressions(self.lines))
        own = findings.suppress_globs(findings.suppress_rules(own, list(o.ignore_rules)), list(o.ignore_globs))
        return findings.suppress_baseline(own, self.baseline).drop("fingerprint") if self.baseline is not None else own

    @cached_property
    def functions(self) -> DataFrame:
        return syntax.complexity(self.facts)

    @cached_property
    def antipatterns(self) -> DataFrame:
        return detect.antipatterns(self.lines)

    @cached_property
    def clones(self) -> DataFrame:
        return findings.clone_pairs(self.lines)

    def scores(self) -> DataFrame:
        """raw_score counts all findings, score those that are not suppressed."""
        of = lambda found: findings.file_score(self.files, found, self.functions, self.clones, self.antipatterns)
        return of(self.raw_findings).select("path", F.col("score").alias("raw_score")).join(of(self.findings), "path")

    def errors(self) -> DataFrame:
        """Files that don't parse; the other detectors work on them all the same."""
        return self.facts.where("kind = 'error'").select("path", F.col("text").alias("error"))

    def owasp(self) -> DataFrame:
        return findings.owasp_coverage(self.findings, self.options.catalog.table(self.files.sparkSession))

    def compliance(self, standards: list[str] | None = None) -> DataFrame:
        return findings.compliance_summary(self.findings, standards)

    def report(self) -> DataFrame:
        """Everything as one list, with anti-patterns and complex functions if asked for."""
        anti = self.antipatterns if self.options.quality else self.antipatterns.limit(0)
        functions = self.functions if self.options.quality else self.functions.limit(0)
        return sinks.ide_union(self.findings, anti, functions)

    def release(self) -> None:
        for name in ("facts", "raw_findings"):
            if name in self.__dict__:
                getattr(self, name).unpersist()

    def exit_code(self, fail_on: str | None) -> int:
        """0 without a threshold or findings as grave, else 1."""
        return findings.fail_on(self.findings, fail_on).first()[0] if fail_on in dims.SEVERITIES else 0


def analyze(files: DataFrame, options: Options | None = None, baseline: DataFrame | None = None) -> Scan:
    """A scan of (path, language, text)."""
    return Scan(files.select("path", "language", "text"), options or Options(), baseline)


def analyze_path(spark: SparkSession, target: str, options: Options | None = None, recursive: bool = True) -> Scan:
    return analyze(F_.read_files(spark, target, recursive), options)


def incremental(files: DataFrame, done: DataFrame) -> DataFrame:
    """The files whose content no earlier scan has seen: `done` holds their `content_sha256`."""
    own = files.withColumn("content_sha256", F.sha2("text", 256))
    return own.join(done.select("content_sha256").distinct(), "content_sha256", "left_anti")
