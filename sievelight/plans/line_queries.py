"""Queries over lines of text: scans, filters, merging, suppression, compliance, sinks, clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import text as T
from ..operators import detect as D
from ..operators import findings as O
from ..operators.catalog import Catalog, Rule
from ..operators.file_rules import file_scan
from ..sources import corpus as C
from ..sources import files, sinks
from ..sources.corpus import quoted as q

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CATALOG = Catalog()


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# The oracle's building blocks -----------------------------------------------------------------------------------------------

LINES = f"lines AS MATERIALIZED ({C.code_lines_sql()})"


COMMENT = "(" + " OR ".join(f"starts_with(trim(text), '{m}')" for m in ("#", "//", "*")) + ")"
DEFINITION = f"regexp_matches(text, {q(D.DEFINITION)})"
TEST = f"regexp_matches(path, {q(D.TEST_PATH)})"


def _rule_sql(i: int, r: Rule, table: str) -> str:
    cond = [] if "*" in r.languages else [f"language IN ({', '.join(map(q, r.languages))})"]
    cond += [f"contains(lower(text), {q(r.need)})"] if r.need else []
    cond.append(f"regexp_matches(text, {q('(?i)' + r.pattern)})")
    cond += [f"NOT regexp_matches(text, {q('(?i)' + r.unless)})"] if r.unless else []
    return f"SELECT path, line_no, text, {q(r.rule_id)} AS rule_id, {q(r.severity)} AS severity, 'CWE-{r.cwe}' AS cwe, '{r.owasp}:2021' AS owasp, {q(r.category)} AS category, {q(r.title)} AS title, {q(r.confidence)} AS confidence, {i} AS rule_seq FROM {table} WHERE " + " AND ".join(cond)


def findings_sql(depth: int = 2, filters: bool = True, **of) -> str:
    """`found`: the rule scan's findings."""
    where = f" AND NOT {COMMENT} AND NOT {DEFINITION}" if filters else ""
    union = "\n UNION ALL ".join(_rule_sql(i, r, "usable") for i, r in CATALOG.of(depth, **of))
    keep = f"WHERE NOT (category IN ({', '.join(map(q, D.SAFE_FOR))}) AND regexp_matches(text, {q(D.SAFE_CALL)}))" if filters else ""
    keep += f" AND (NOT {TEST} OR severity = 'critical')" if filters and depth < 3 else ""
    return f"""{LINES}, usable AS MATERIALIZED (SELECT * FROM lines WHERE length(text) <= 2000 AND trim(text) <> ''{where}),
found AS MATERIALIZED (SELECT path, line_no, rule_id, severity, cwe, owasp, category, title, substr(trim(text), 1, 120) AS snippet, confidence, 'rule' AS source, rule_seq FROM ({union}) {keep})"""


FOUND = findings_sql()
PROVIDER = f"""provider AS (SELECT path, line_no, 'SECRET-' || upper(replace(name, ' ', '-')) AS rule_id, severity, redacted AS snippet FROM (
{" UNION ALL ".join(f"SELECT path, line_no, {q(n)} AS name, {q(s)} AS severity, text FROM lines WHERE NOT (starts_with(trim(text), '#') OR starts_with(trim(text), '//')) AND regexp_matches(text, {q(p)})" for n, s, p in D.PROVIDERS)}) x,
LATERAL (SELECT substr(regexp_replace(trim(x.text), '(["''])([0-9a-zA-Z_/+=.-]{{4}})[0-9a-zA-Z_/+=.-]{{6,}}([0-9a-zA-Z_/+=.-]{{2}})(["''])', '\\1\\2***REDACTED***\\3\\4', 'g'), 1, 120) AS redacted))"""
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"
WEIGHT = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 12 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END"
FINGERPRINT = "substr(sha256(rule_id || ':' || path || ':' || trim(snippet)), 1, 16)"
CORE = "path, line_no, rule_id, severity, cwe, category"
#: A second detector for the merge queries, made of the scan's own rows: findings of the secret scanner, and rows that stand for data-flow and taint.
_EVERY = f"""{PROVIDER}, every AS MATERIALIZED (
SELECT path, line_no, rule_id, severity, cwe, category, snippet, confidence, 'rule' AS source, 1000 + rule_seq AS seq FROM found
UNION ALL SELECT path, line_no, rule_id, severity, 'CWE-798', 'secrets', snippet, 'high', 'secret-scanner', 3000 FROM provider
UNION ALL SELECT path, line_no, 'TAINT-' || replace(cwe, '-', '_'), severity, cwe, 'taint', snippet, 'medium', 'taint', 0 FROM found WHERE category IN ('command', 'rce') AND line_no % 2 = 0
UNION ALL SELECT path, line_no, 'DFLOW-' || replace(cwe, '-', '_'), severity, cwe, 'dataflow', snippet, 'medium', 'dataflow', 2000 FROM found WHERE category IN ('command', 'sql') AND line_no % 3 > 0)"""
UNION = f"{FOUND}, {_EVERY}"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return C.code_lines(spark, d)


def found(spark: SparkSession, d: str, **k) -> DataFrame:
    return D.rule_scan(lines(spark, d), CATALOG, **k)


def every(spark: SparkSession, d: str) -> DataFrame:
    """The union of detectors, from one scan: a finding, and what stands for a taint or data-flow finding of it, are one array to explode."""
    name = lambda p: F.concat(F.lit(p), F.replace("cwe", F.lit("-"), F.lit("_")))
    one = lambda rule, category, confidence, source, seq: F.struct(rule.alias("rule_id"), category.alias("category"), confidence.alias("confidence"), F.lit(source).alias("source"), seq.cast("int").alias("rule_seq"))
    made = lambda p, s: one(name(p), F.lit(s), F.lit("medium"), s, F.lit(0))
    own = one(F.col("rule_id"), F.col("category"), F.col("confidence"), "rule", F.col("rule_seq"))
    taint = F.when(F.expr("category in ('command', 'rce') and line_no % 2 = 0"), made("TAINT-", "taint"))
    flow = F.when(F.expr("category in ('command', 'sql') and line_no % 3 > 0"), made("DFLOW-", "dataflow"))
    all_ = found(spark, d).select("path", "line_no", "severity", "cwe", "snippet", F.explode_outer(F.array_compact(F.array(own, taint, flow))).alias("x"))
    return O.union_detectors(all_.select("path", "line_no", "severity", "cwe", "snippet", "x.*"), D.secret_providers(lines(spark, d)))


def core(df: DataFrame, *more: str) -> DataFrame:
    return df.select("path", "line_no", "rule_id", "severity", "cwe", "category", *more)


# Sources and scalars ----------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT path, language, count(*) AS n FROM lines WHERE regexp_matches(path, '\\.(py|js|java|go|rb|php|html|yaml|sh|css|gradle)$') AND NOT starts_with(path, 'build/') GROUP BY ALL")
def scan_filter(spark, d):
    return lines(spark, d).where(files.keep_path()).groupBy("path", "language").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN 'pom.xml' WHEN p_partkey % 5 = 1 THEN 'a/B' || p_partkey || '.PY' WHEN p_partkey % 5 = 2 THEN 'a.b/c' || p_partkey WHEN p_partkey % 5 = 3 THEN 'x.' || p_partkey || '.rs' ELSE 'build.gradle.kts' END AS path, CASE WHEN p_partkey % 5 = 0 THEN 'maven' WHEN p_partkey % 5 = 1 THEN 'python' WHEN p_partkey % 5 = 2 THEN 'unknown' WHEN p_partkey % 5 = 3 THEN 'rust' ELSE 'gradle' END AS language FROM part")
def detect_language(spark, d):
    k = F.col("p_partkey")
    path = F.when(k % 5 == 0, "pom.xml").when(k % 5 == 1, F.concat(F.lit("a/B"), k.cast("string"), F.lit(".PY"))).when(k % 5 == 2, F.concat(F.lit("a.b/c"), k.cast("string")))
    path = path.when(k % 5 == 3, F.concat(F.lit("x."), k.cast("string"), F.lit(".rs"))).otherwise("build.gradle.kts")
    return spark.read.parquet(f"{d}/part.parquet").select(path.alias("path")).select("path", T.detect_language("path").alias("language"))


@query("SELECT * FROM (VALUES ('depth', '3'), ('all', 'false'), ('ignore_rule', 'A,B'), ('fail_on', 'high')) t(option, value)")
def config_merge(spark, d):
    merged = files.merge_config({"depth": 3, "ignore_rule": ["B"]}, '{"depth": 1, "ignore_rule": ["A"], "fail_on": "high"}')
    rows = [(k, ",".join(v) if isinstance(v, list) else str(v).lower()) for k, v in merged.items()]
    return spark.createDataFrame(rows, "option string, value string")


@query("SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents")
def line_explode(spark, d):
    return C.lines_of(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")


_AT = "strpos(text, 'the')"


@query(f"SELECT doc_id, CAST(length(substr(text, 1, {_AT} - 1)) - length(replace(substr(text, 1, {_AT} - 1), chr(10), '')) + 1 AS BIGINT) AS line_no FROM documents WHERE contains(text, 'the')")
def match_line_no(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").contains("the"))
    return docs.select("doc_id", T.match_line_no("text", F.instr("text", "the") - 1).cast("long").alias("line_no"))


@query(f"SELECT doc_id, CAST(length(string_split(substr(text, 1, {_AT} - 1), chr(10))[-1]) AS BIGINT) AS col FROM documents WHERE contains(text, 'the')")
def match_col(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("text").contains("the"))
    return docs.select("doc_id", T.match_col("text", F.instr("text", "the") - 1).cast("long").alias("col"))


@query(f"WITH {LINES} SELECT path, line_no, regexp_replace(text, '([\"''])([0-9a-zA-Z_/+=.-]{{4}})[0-9a-zA-Z_/+=.-]{{6,}}([0-9a-zA-Z_/+=.-]{{2}})([\"''])', '\\1\\2***REDACTED***\\3\\4', 'g') AS text FROM lines WHERE contains(text, '\"')")
def redact_secret(spark, d):
    return lines(spark, d).where(F.col("text").contains('"')).select("path", "line_no", T.redact("text").alias("text"))


@query("WITH l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS text FROM documents) SELECT path, count(*) AS total, count(*) FILTER (trim(text) <> '' AND NOT starts_with(trim(text), '#')) AS code, count(*) FILTER (starts_with(trim(text), '#')) AS comments FROM l GROUP BY path")
def loc_metrics(spark, d):
    return O.loc_metrics(C.lines_of(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").withColumnRenamed("doc_id", "path"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#.*$', '', 'g'), '\"[^\"]*\"|''[^'']*''', '\"\"', 'g'), '(^|[^0-9A-Za-z_])[0-9]+', '\\10', 'g'), '[ \\t\\r\\f\\v]+', ' ', 'g'))"


@query(f"WITH {LINES} SELECT path, line_no, {_NORM} AS line FROM lines")
def normalize_line(spark, d):
    return lines(spark, d).select("path", "line_no", T.normalise_line("text").alias("line"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, CAST({v[0]} AS INT), CAST({v[1]} AS INT), {q(v[2])}, {q(v[3])}, CAST({v[4]} AS DOUBLE), {q(v[5])})" for k, v in dims.SEVERITIES.items()) + ") t(severity, rank, weight, level, score, cvss, editor)")
def severity_dim(spark, d):
    return dims.severities(spark)


@query(f"WITH {LINES} SELECT path, line_no, CAST(length(text) AS BIGINT) AS n, CASE WHEN length(text) > 2000 THEN '' ELSE trim(text) END AS text FROM lines")
def long_line_guard(spark, d):
    return lines(spark, d).select("path", "line_no", F.length(T.long_line_guard("text")).cast("long").alias("n"), F.trim(T.long_line_guard("text")).alias("text"))


# Filters ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT path, line_no, text FROM lines WHERE {COMMENT}")
def filter_comments(spark, d):
    return lines(spark, d).where(D.is_comment(F.col("text"))).select("path", "line_no", "text")


@query(f"WITH {LINES} SELECT path, line_no, text FROM lines WHERE {DEFINITION}")
def filter_rule_definitions(spark, d):
    return lines(spark, d).where(D.is_definition(F.col("text"))).select("path", "line_no", "text")


@query(f"WITH {findings_sql(filters=False)} SELECT {CORE} FROM found WHERE category IN ({', '.join(map(q, D.SAFE_FOR))}) AND regexp_matches(snippet, {q(D.SAFE_CALL)})")
def filter_safe_context(spark, d):
    return core(found(spark, d, filters=False).where(D.is_safe_context(F.col("snippet"), F.col("category"))))


@query(f"WITH {LINES} SELECT path, count(*) AS n FROM lines WHERE {TEST} GROUP BY path")
def filter_test_files(spark, d):
    return lines(spark, d).where(D.is_test_path(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {findings_sql(depth=1)} SELECT {CORE} FROM found")
def depth_filter(spark, d):
    return core(found(spark, d, depth=1))


@query(f"WITH {findings_sql(depth=3)} SELECT severity, count(*) AS n FROM found GROUP BY severity")
def depth_three(spark, d):
    return found(spark, d, depth=3).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {FOUND} SELECT {CORE} FROM found WHERE rule_id NOT IN ('INJ-EVAL-001', 'CRY-HASH-001')")
def ignore_rule(spark, d):
    return core(O.suppress_rules(found(spark, d), ["INJ-EVAL-001", "CRY-HASH-001"]))


@query(f"WITH {FOUND} SELECT {CORE} FROM found WHERE {RANK} <= 1")
def min_severity(spark, d):
    return core(O.min_severity(found(spark, d), "high"))


@query(f"WITH {FOUND} SELECT {CORE} FROM found WHERE NOT regexp_matches(path, '^src/f1.*$') AND NOT regexp_matches(path, '^.*\\.js$')")
def ignore_path_glob(spark, d):
    return core(O.suppress_globs(found(spark, d), ["src/f1*", "*.js"]))


# Scans ----------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT language, CAST(count(DISTINCT r.rule_id) AS BIGINT) AS n_rules FROM (SELECT DISTINCT language FROM lines) l JOIN (VALUES " + ", ".join(f"({q(r.rule_id)}, {q(x)})" for r in CATALOG.rules for x in r.languages) + ") r(rule_id, tag) ON r.tag = '*' OR r.tag = l.language GROUP BY language")
def rule_join(spark, d):
    """Which rules apply to which language: an equi-join on exploded tags, `*` first turned into every language."""
    tags = CATALOG.table(spark).select("rule_id", F.explode("languages").alias("tag"))
    own = lines(spark, d).select("language").distinct()
    keys = own.select("language", F.explode(F.array("language", F.lit("*"))).alias("tag"))
    return keys.join(F.broadcast(tags), "tag").groupBy("language").agg(F.count_distinct("rule_id").alias("n_rules"))


@query(f"WITH {FOUND} SELECT {CORE}, owasp, snippet, confidence FROM found")
def rule_scan(spark, d):
    return core(found(spark, d), "owasp", "snippet", "confidence")


#: template, line, column, rule and snippet of what is found in `corpus.CALLS`
_CALLS = [
    (0, 2, 0, "INJ-CMD-001", "subprocess.run("), (2, 1, 4, "SSRF-001", "r = requests.get("), (3, 3, 0, "INJ-EVAL-001", "eval(a)"), (4, 1, 16, "INJ-CMD-003", "const p = child.exec("),
    (6, 1, 4, "DES-YAML-001", "d = yaml.load(f{n})"), (7, 4, 0, "HTML-IFRAME-SANDBOX-001", "<iframe src=b>"),
]


@query("SELECT 'c' || event_id || '.' || suffix AS path, CAST(line_no AS BIGINT) AS line_no, CAST(col AS INT) AS col, rule_id, replace(snippet, '{n}', CAST(event_id AS VARCHAR)) AS snippet FROM events JOIN (VALUES " + ", ".join(f"({k}, {q(C.CALLS[k][0])}, {n}, {col}, {q(r)}, {q(s)})" for k, n, col, r, s in _CALLS) + f") t(kind, suffix, line_no, col, rule_id, snippet) ON event_id % {len(C.CALLS)} = t.kind")
def rule_scan_files(spark, d):
    """The scan of whole files, whose calls go over lines."""
    return file_scan(C.calls(spark, d), CATALOG).select("path", "line_no", "col", "rule_id", "snippet")


def _family(name: str, **of) -> None:
    def run(spark, d):
        return core(found(spark, d, **of))

    run.__name__ = f"rule_scan_{name}"
    query(f"WITH {findings_sql(**of)} SELECT {CORE} FROM found")(run)


for _name, _of in (
    ("injection", {"categories": ("sql", "nosql", "command", "rce", "ssti", "xpath", "ldap", "xxe", "crlf", "log")}), ("crypto", {"categories": ("crypto",)}), ("auth", {"categories": ("secrets", "jwt", "password", "session", "cookie")}),
    ("deser", {"categories": ("deserialization",)}), ("access", {"categories": ("access", "upload", "path")}), ("ssrf", {"categories": ("ssrf",)}), ("config", {"categories": ("config",)}), ("html", {"families": ("HTML", "XSS")}),
    ("css", {"families": ("CSS",)}), ("build", {"families": ("MVN", "GRADLE")}), ("systems", {"families": ("C", "RUST", "GO", "SWIFT")}), ("web", {"families": ("PHP", "FW", "RB", "JS")}), ("shell", {"families": ("SH", "YAML", "SQL")}),
):
    _family(_name, **_of)


@query("WITH r AS (SELECT * FROM (VALUES " + ", ".join(f"({q(r.severity)}, {q(r.owasp)}, {q(r.category)})" for r in CATALOG.rules) + ") t(severity, owasp, category)) SELECT coalesce(severity, '') AS severity, coalesce(owasp, '') AS owasp, coalesce(category, '') AS category, count(*) AS n FROM r GROUP BY GROUPING SETS ((severity), (owasp), (category), ())")
def rule_stats(spark, d):
    rules = CATALOG.table(spark).select("severity", F.substring("owasp", 1, 3).alias("owasp"), "category")
    own = rules.groupingSets([["severity"], ["owasp"], ["category"], []], "severity", "owasp", "category").agg(F.count("*").alias("n"))
    return own.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("severity", "owasp", "category")], "n")


@query(f"WITH {LINES}, {PROVIDER} SELECT * FROM provider")
def secret_provider(spark, d):
    return D.secret_providers(lines(spark, d)).select("path", "line_no", "rule_id", "severity", "snippet")


_BITS = "list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: -((length(t) - length(replace(t, c, ''))) / length(t)) * log2((length(t) - length(replace(t, c, ''))) / length(t))))"


def _entropy_sql(source: str, threshold: float) -> str:
    return f"""tokens AS (SELECT path, line_no, t, i, {_BITS} AS bits FROM (SELECT path, line_no, unnest(x) AS t, unnest(range(1, len(x) + 1)) AS i FROM (SELECT path, line_no, list_transform(regexp_extract_all(text, {q(D.QUOTED_TOKEN)}), lambda t: substr(t, 2, length(t) - 2)) AS x FROM {source} WHERE regexp_matches(text, {q(D.SECRET_HINT)}))))
SELECT path, line_no, round(arg_min(bits, i), 6) AS bits FROM tokens WHERE bits > {threshold} AND NOT ((length(t) - length(replace(t, '/', '')) >= 2 AND NOT contains(t, ' ')) OR starts_with(t, 'http')) GROUP BY path, line_no"""


@query(f"WITH {LINES}, {_entropy_sql('lines', 4.0)}")
def secret_entropy(spark, d):
    return D.secret_entropy(lines(spark, d)).select("path", "line_no", F.round("bits", 6).alias("bits"))


@query(f"WITH docs AS (SELECT doc_id AS path, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents), {_entropy_sql('docs', 3.5)}")
def secret_entropy_documents(spark, d):
    own = C.lines_of(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").withColumnRenamed("doc_id", "path")
    return D.secret_entropy(own, 3.5).select("path", "line_no", F.round("bits", 6).alias("bits"))


_GUARD = "CASE WHEN length(text) > 2000 THEN '' ELSE text END"


@query(f"WITH {LINES}, g AS MATERIALIZED (SELECT path, line_no, {_GUARD} AS text, lag({_GUARD}) OVER (PARTITION BY path ORDER BY line_no) AS before FROM lines) " + " UNION ALL ".join(f"SELECT path, line_no, {q(i)} AS rule_id, {q(s)} AS severity FROM g WHERE NOT starts_with(trim(text), '#') AND regexp_matches(text, {q(p)})" for i, s, _, p in D.ANTIPATTERNS) + f" UNION ALL SELECT path, line_no, 'AP-STRING-CONCAT-LOOP', 'medium' FROM g WHERE NOT starts_with(trim(text), '#') AND regexp_matches(before, {q(D.LOOP_HEAD)}) AND regexp_matches(text, {q(D.LOOP_CONCAT)})")
def antipattern_scan(spark, d):
    return D.antipatterns(lines(spark, d)).select("path", "line_no", "rule_id", "severity")


#: The legacy scan: thirty rules without languages, each the general form of catalog rules.
LEGACY = {
    "PAT-SQL-FSTRING": "INJ-SQL-001", "PAT-SQL-CONCAT": "INJ-SQL-002", "PAT-EVAL": "INJ-EVAL-001", "PAT-EXEC": "INJ-EXEC-001", "PAT-PICKLE": "DES-PICKLE-001", "PAT-YAML-UNSAFE": "DES-YAML-001", "PAT-SHELL-TRUE": "INJ-CMD-001", "PAT-OS-SYSTEM": "INJ-CMD-002",
    "PAT-HARDCODED-SECRET": "AUTH-SECRET-001", "PAT-SECRET-IN-LOG": "MISC-PRINT-SECRET-001", "PAT-JWT-NONE": "AUTH-JWT-001", "PAT-WEAK-HASH": "CRY-HASH-001", "PAT-WEAK-RAND": "CRY-RAND-001", "PAT-TIMING": "CRY-TIMING-001", "PAT-SSL-VERIFY-OFF": "CFG-SSL-001",
    "PAT-DEBUG-TRUE": "CFG-DEBUG-001", "PAT-CORS-WILDCARD": "CFG-CORS-001", "PAT-COOKIE-NO-FLAGS": "AUTH-COOKIE-001", "PAT-PATH-TRAVERSAL": "ACC-PATH-001", "PAT-OPEN-REDIRECT": "ACC-REDIRECT-001", "PAT-MASS-ASSIGN": "ACC-MASS-001", "PAT-ASSERT-SECURITY": "CFG-ASSERT-001",
    "PAT-LOG-INJECTION": "INJ-LOG-001", "PAT-PROTOTYPE-POLLUTION": "MISC-PROTO-POLLUTION-001", "PAT-REDOS": "DOS-REDOS-001", "PAT-TLS-OLD": "CRY-TLS-001", "PAT-SSRF": "SSRF-001",
}
_LEGACY_OWN = (
    Rule("PAT-BARE-EXCEPT", "medium", 755, "A04", "code", ("*",), "bare except", "except", r"except\s*:"), Rule("PAT-HARDCODED-IP", "low", 547, "A05", "config", ("*",), "address in the code", ".", r"[\"']\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}[\"']"),
    Rule("PAT-TOCTOU", "medium", 377, "A04", "code", ("*",), "check before use", "exists", r"if\s+os\.path\.exists\("),
)
_BY_ID = {r.rule_id: r for r in CATALOG.rules}
LEGACY_CATALOG = Catalog([*(Rule(k, (r := _BY_ID[v]).severity, r.cwe, r.owasp, r.category, ("*",), r.title, r.need, r.pattern, r.unless) for k, v in LEGACY.items()), *_LEGACY_OWN])


@query(f"WITH {LINES}, usable AS MATERIALIZED (SELECT * FROM lines WHERE length(text) <= 2000 AND trim(text) <> '') SELECT {CORE} FROM (" + " UNION ALL ".join(_rule_sql(i, r, "usable") for i, r in LEGACY_CATALOG.of(3)) + ")")
def legacy_pattern_scan(spark, d):
    return core(D.rule_scan(lines(spark, d), LEGACY_CATALOG, 3, filters=False))


# Merging and aggregates ---------------------------------------------------------------------------------------------------------


@query(f"WITH {FOUND} SELECT path, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in dims.SEVERITIES) + ", count(*) AS total FROM found GROUP BY path")
def severity_summary(spark, d):
    return O.severity_summary(found(spark, d))


@query(f"WITH {UNION} SELECT {CORE}, source, CAST(seq AS BIGINT) AS seq FROM every")
def union_detectors(spark, d):
    return core(every(spark, d), "source", "seq")


@query(f"WITH {UNION}, r AS (SELECT DISTINCT path, line_no FROM every WHERE source = 'rule'), t AS (SELECT DISTINCT path, line_no FROM every WHERE source = 'taint') SELECT {CORE}, source, CASE WHEN r.path IS NULL THEN confidence ELSE 'confirmed' END AS confidence FROM every LEFT JOIN r USING (path, line_no) WHERE source = 'taint' UNION ALL SELECT {CORE}, source, confidence FROM every ANTI JOIN t USING (path, line_no) WHERE source = 'rule' UNION ALL SELECT {CORE}, source, confidence FROM every WHERE source NOT IN ('taint', 'rule')")
def merge_taint_over_rule(spark, d):
    return core(O.merge_taint_over_rule(every(spark, d)), "source", "confidence")


@query(f"WITH {UNION}, o AS (SELECT DISTINCT path, line_no, cwe FROM every WHERE source <> 'dataflow') SELECT {CORE}, source FROM every WHERE source <> 'dataflow' UNION ALL SELECT {CORE}, source FROM every ANTI JOIN o USING (path, line_no, cwe) WHERE source = 'dataflow'")
def merge_dataflow(spark, d):
    return core(O.merge_dataflow(every(spark, d)), "source")


@query(f"WITH {UNION}, o AS (SELECT DISTINCT path, line_no FROM every WHERE source NOT IN ('secret-scanner', 'entropy') AND category = 'secrets') SELECT {CORE}, source FROM every WHERE source NOT IN ('secret-scanner', 'entropy') UNION ALL SELECT {CORE}, source FROM every ANTI JOIN o USING (path, line_no) WHERE source IN ('secret-scanner', 'entropy')")
def merge_secrets(spark, d):
    return core(O.merge_secrets(every(spark, d)), "source")


@query(f"WITH {UNION} SELECT {CORE}, source, CASE WHEN (SELECT count(DISTINCT source) FROM every r WHERE r.path = e.path AND r.line_no = e.line_no AND r.cwe = e.cwe) >= 2 THEN 'confirmed' ELSE confidence END AS confidence FROM every e")
def confirm_multi_source(spark, d):
    return core(O.confirm_multi_source(every(spark, d)), "source", "confidence")


@query(f"WITH {UNION} SELECT {CORE}, source, (SELECT string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) FROM every r WHERE r.path = e.path AND r.line_no = e.line_no AND r.cwe = e.cwe AND r.category = e.category) AS rule_ids FROM every e QUALIFY row_number() OVER (PARTITION BY path, line_no, cwe, category ORDER BY seq, rule_id) = 1")
def dedupe_findings(spark, d):
    return core(O.dedupe(every(spark, d)), "source", "rule_ids")


@query(f"WITH {UNION} SELECT CAST(row_number() OVER (ORDER BY {RANK}, path, line_no, seq, rule_id) AS BIGINT) AS place, path, line_no, rule_id FROM every")
def sort_findings(spark, d):
    """All findings with their place in the order."""
    return O.placed(every(spark, d)).select("place", "path", "line_no", "rule_id")


@query(f"WITH {FOUND} SELECT path, CAST(greatest(0, 100 - coalesce(p, 0)) AS BIGINT) AS score, CASE WHEN greatest(0, 100 - coalesce(p, 0)) >= 90 THEN 'A' WHEN greatest(0, 100 - coalesce(p, 0)) >= 75 THEN 'B' WHEN greatest(0, 100 - coalesce(p, 0)) >= 55 THEN 'C' WHEN greatest(0, 100 - coalesce(p, 0)) >= 35 THEN 'D' ELSE 'F' END AS grade FROM (SELECT DISTINCT path FROM lines) LEFT JOIN (SELECT path, sum({WEIGHT}) AS p FROM found GROUP BY path) USING (path)")
def file_score(spark, d):
    return O.file_score(lines(spark, d), found(spark, d))


@query(f"WITH {FOUND} SELECT owasp, count(*) AS n FROM found GROUP BY owasp")
def owasp_coverage(spark, d):
    return O.owasp_coverage(found(spark, d).drop("owasp"), CATALOG.table(spark))


@query(f"WITH {FOUND} SELECT path, count(*) AS n FROM found GROUP BY path ORDER BY n DESC, path LIMIT 20")
def topk_files(spark, d):
    return found(spark, d).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(20)


# Suppression and gates --------------------------------------------------------------------------------------------------------


_MARKS = f"marks AS (SELECT path, line_no, trim(unnest(string_split(ids, ','))) AS rule_id FROM (SELECT path, line_no, regexp_extract(text, {q(O.MARK_RULES)}, 1) AS ids FROM lines) WHERE ids <> '' UNION ALL SELECT path, line_no, NULL FROM lines WHERE regexp_extract(text, {q(O.MARK_RULES)}, 1) = '' AND regexp_matches(text, {q(O.MARK)}))"


@query(f"WITH {FOUND}, {_MARKS} SELECT {CORE} FROM found f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.path = f.path AND m.line_no = f.line_no AND (m.rule_id IS NULL OR m.rule_id = f.rule_id))")
def suppress_inline(spark, d):
    return core(O.suppress_inline(found(spark, d), O.suppressions(lines(spark, d))))


@query(f"WITH {FOUND}, {_MARKS} SELECT count(*) AS suppressed FROM found f WHERE EXISTS (SELECT 1 FROM marks m WHERE m.path = f.path AND m.line_no = f.line_no AND (m.rule_id IS NULL OR m.rule_id = f.rule_id))")
def suppressed_count(spark, d):
    return O.suppressed_inline(found(spark, d), O.suppressions(lines(spark, d))).agg(F.count("*").alias("suppressed"))


@query(f"WITH {FOUND}, f AS MATERIALIZED (SELECT *, {FINGERPRINT} AS fingerprint FROM found), b AS (SELECT DISTINCT fingerprint FROM f WHERE line_no % 3 = 0) SELECT {CORE} FROM f ANTI JOIN b USING (fingerprint)")
def suppress_baseline(spark, d):
    own = found(spark, d)
    return core(O.suppress_baseline(own, O.baseline(own.where("line_no % 3 = 0"))))


@query(f"WITH {FOUND} SELECT {CORE} FROM found WHERE rule_id <> 'CFG-SSL-001'")
def suppress_rule(spark, d):
    rules, _ = files.parse_ignore(spark.createDataFrame([("# note",), ("rule:CFG-SSL-001",), ("docs/*",)], "value string"))
    return core(found(spark, d).join(F.broadcast(rules), "rule_id", "left_anti"))


@query(f"WITH {FOUND} SELECT DISTINCT {FINGERPRINT} AS fingerprint FROM found")
def baseline_create(spark, d):
    return O.baseline(found(spark, d))


@query(f"WITH {FOUND} SELECT CAST(coalesce(max(CASE WHEN {RANK} <= 1 THEN 1 ELSE 0 END), 0) AS BIGINT) AS exit_code FROM found")
def fail_on_gate(spark, d):
    return O.fail_on(found(spark, d), "high")


_CONTROLS = "controls(standard, control_id, cwe, level) AS (VALUES " + ", ".join(f"({q(s)}, {q(c)}, 'CWE-{n}', '{'required' if r else 'recommended'}')" for s, c, cwes, r in dims.CONTROLS for n in cwes) + "), evaluated AS (SELECT standard, control_id, level, CAST(count(f.cwe) AS BIGINT) AS violations, CASE WHEN count(f.cwe) > 0 THEN 'fail' ELSE 'pass' END AS status FROM controls c LEFT JOIN found f ON f.cwe = c.cwe GROUP BY ALL)"


@query(f"WITH {FOUND}, {_CONTROLS} SELECT * FROM evaluated")
def compliance_eval(spark, d):
    return O.compliance(found(spark, d))


_SUMMARY = "SELECT standard, count(*) AS total, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS failed, round(100.0 * count(*) FILTER (status = 'pass') / count(*), 1) AS percent, count(*) FILTER (status = 'fail') = 0 AS compliant FROM evaluated"


@query(f"WITH {FOUND}, {_CONTROLS} {_SUMMARY} WHERE standard = 'PCI_DSS' GROUP BY standard")
def compliance_summary(spark, d):
    return O.compliance_summary(found(spark, d), ["PCI_DSS"])


@query(f"WITH {FOUND}, {_CONTROLS} {_SUMMARY} GROUP BY standard")
def compliance_all(spark, d):
    return O.compliance_summary(found(spark, d))


# Sinks ----------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {FOUND} SELECT path, CAST(-1 AS BIGINT) AS seq, path || ': ' || count(*) || ' findings' AS line FROM found GROUP BY path UNION ALL SELECT path, CAST(1000 + rule_seq AS BIGINT), '  [' || upper(severity) || '] line ' || line_no || ': ' || rule_id || ' (' || cwe || ')' FROM found")
def sink_text(spark, d):
    return sinks.text_lines(O.union_detectors(found(spark, d)))


@query(f"WITH {FOUND} SELECT path || ':' || line_no || ':1: ' || CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'info' END || ': ' || title || ' [' || cwe || '] (' || severity || ')' AS line FROM found")
def sink_problem_matcher(spark, d):
    return sinks.problem_lines(found(spark, d).withColumn("col", F.lit(0)))


@query(f"WITH {FOUND} SELECT path, CAST(count(*) AS BIGINT) AS n, CAST(min(line_no) AS BIGINT) AS first_line FROM found GROUP BY path")
def sink_json(spark, d):
    rows = sinks.json_rows(found(spark, d))
    parsed = F.from_json("json", "array<struct<line_no long, rule_id string>>")
    return rows.select("path", F.size(parsed).cast("long").alias("n"), F.array_min(F.transform(parsed, lambda x: x["line_no"])).alias("first_line"))


@query(f"WITH {FOUND} SELECT rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, CASE severity WHEN 'critical' THEN '9.8' WHEN 'high' THEN '7.5' WHEN 'medium' THEN '5.0' WHEN 'low' THEN '2.0' ELSE '0.0' END AS security_severity FROM (SELECT DISTINCT rule_id, severity FROM found)")
def sink_sarif_rules(spark, d):
    return sinks.sarif_rules(found(spark, d)).drop("name")


@query(f"WITH {FOUND} SELECT rule_id, path, CAST(line_no AS VARCHAR) AS line, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, {FINGERPRINT} AS fingerprint FROM found")
def sink_sarif_results(spark, d):
    get = lambda p: F.get_json_object("result", p)
    place = "$.locations[0].physicalLocation"
    return sinks.sarif_results(found(spark, d)).select("rule_id", get(f"{place}.artifactLocation.uri").alias("path"), get(f"{place}.region.startLine").alias("line"), get("$.level").alias("level"), get("$.fingerprints.primary").alias("fingerprint"))


@query(f"WITH {FOUND} SELECT path, line_no, rule_id, '<tr><td>' || severity || '</td><td>' || path || '</td><td>' || line_no || '</td><td>' || rule_id || '</td><td>' || replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</td></tr>' AS html FROM found")
def report_rows(spark, d):
    return sinks.report_rows(found(spark, d))


@query("SELECT * FROM (VALUES " + ", ".join(f"({q(r.rule_id)}, {q(chr(10).join([r.title, f'Weakness: CWE-{r.cwe}', f'Class: {r.owasp}:2021', f'Severity: {r.severity}']))})" for r in CATALOG.rules) + ") t(rule_id, help)")
def sink_sarif_help(spark, d):
    return sinks.rule_help(CATALOG.table(spark))


# Clones, snapshots ----------------------------------------------------------------------------------------------------------------

_DOC_LINES = "l AS (SELECT doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS text FROM documents)"
_WINDOWS = f"""{_DOC_LINES}, n AS (SELECT doc_id, line_no, {_NORM} AS line FROM l),
w AS (SELECT doc_id, line_no, list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS x FROM n),
b AS (SELECT doc_id, line_no, md5(array_to_string(x, chr(10))) AS block FROM w WHERE len(x) = 6 AND NOT list_contains(x, ''))"""


def _doc_lines(spark, d):
    return C.lines_of(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")


@query(f"WITH {_WINDOWS} SELECT * FROM b")
def clone_windows(spark, d):
    return O.clone_windows(_doc_lines(spark, d), 6, "doc_id")


@query(f"WITH {_WINDOWS} SELECT doc_id, first_line, line_no AS duplicate_line, CAST(6 AS BIGINT) AS block_size FROM (SELECT *, min(line_no) OVER (PARTITION BY doc_id, block) AS first_line FROM b) WHERE line_no > first_line")
def clone_pairs(spark, d):
    return O.clone_pairs(_doc_lines(spark, d), 6, "doc_id")


@query("WITH s AS (SELECT 'u' || user_id AS path, CAST(max(event_id) FILTER (event_id % 2 = 0) AS BIGINT) AS old, CAST(max(event_id) AS BIGINT) AS mtime FROM events GROUP BY user_id) SELECT path, mtime FROM s WHERE old IS NULL OR old <> mtime")
def watch_diff(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), "event_id")
    snap = lambda df: df.groupBy("path").agg(F.max("event_id").alias("mtime"))
    return files.snapshot_diff(snap(e.where("event_id % 2 = 0")), snap(e))
