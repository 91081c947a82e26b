"""Rules over whole files: the catalog's rules across lines, and something without something else near it.

Offsets need no Python: the lengths of the pieces between matches and of the matches give each match its place, and the place its
line and column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import to_lines
from . import detect as D
from .catalog import Catalog, Rule

#: id, severity, CWE, OWASP, category, languages, title, pattern, what must be near, characters that it may be away
FILE_RULES = (
    ("FW-EXPRESS-002", "low", 693, "A05", "config", ("javascript", "typescript"), "application without helmet", r"express\(\)", r"helmet\(", 400),
    ("FW-SPRING-003", "low", 862, "A01", "access", ("java",), "mutating mapping without authorization", r"@(Post|Put|Delete|Patch)Mapping", r"@(PreAuthorize|Secured|RolesAllowed)", 200),
    ("FW-JAVA-XXE-001", "high", 611, "A05", "xxe", ("java", "kotlin"), "XML factory without setFeature", r"DocumentBuilderFactory\.newInstance\(", r"setFeature\(", 300),
    ("FW-GQL-001", "low", 770, "A05", "dos", ("python", "javascript"), "schema without a depth limit", r"(GraphQLSchema|ApolloServer)\(", r"depth_?limit", 400),
    ("AP-STRING-CONCAT-LOOP", "medium", 1046, "A06", "code", ("python",), "string built in a loop", r"for [^\n]+:[ \t]*\n[ \t]*[A-Za-z_0-9]+ *\+= *[\"']", "", 0),
    ("FW-FLASK-004", "low", 200, "A01", "access", ("python",), "route that runs SQL itself", r"@app\.route\s*\([^)]*\)\s*\n\s*def\s+\w+\(\):[^#]*\.execute\(", "", 0),
)


def matches(text: Column, pattern: Column | str, keep=None) -> Column:
    """Array of (start from 0, text) of all matches, or of those whose text `keep` holds; the pattern must not match the empty text."""
    gaps, own = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), own.alias("own")), lambda x: x["own"].isNotNull())
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,text:string>>").alias("all"))

    def add(acc: Column, x: Column) -> Column:
        at = acc["end"] + F.length(x["gap"])
        all_ = F.concat(acc["all"], F.array(F.struct(at.alias("start"), x["own"].alias("text"))))
        return F.struct((at + F.length(x["own"])).alias("end"), (F.when(keep(x["own"]), all_).otherwise(acc["all"]) if keep else all_).alias("all"))

    return F.aggregate(zipped, start, add)["all"]


def _far(i: int, pattern: str, near: str, away: int) -> Column:
    """Array of (rule, start) of the matches without `near` in what follows them."""
    text = F.col("text")

    def alone(m: Column) -> Column:
        return ~F.substring(text, m["start"] + 1, F.length(m["text"]) + F.lit(away)).rlike(f"(?i){near}")

    found = matches(text, f"(?i){pattern}")
    return F.transform(F.filter(found, alone) if near else found, lambda m: F.struct(F.lit(i).alias("i"), m["start"].alias("start")))


def file_rule_scan(files: DataFrame) -> DataFrame:
    """Findings of (path, language, text), with line and column from their offsets."""
    found = []
    for i, (_, _, _, _, _, languages, _, pattern, near, away) in enumerate(FILE_RULES):
        some = F.col("language").isin(*languages) & F.col("text").rlike(f"(?i){pattern}")
        found.append(F.when(some, _far(i, pattern, near, away)))
    empty = F.array().cast("array<struct<i:int,start:int>>")
    rows = files.select("path", "text", F.explode_outer(F.concat(*[F.coalesce(x, empty) for x in found])).alias("x")).where("x is not null")
    get = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in FILE_RULES]), F.col("x.i") + 1)
    line = T.match_line_no("text", F.col("x.start"))
    own = F.element_at(F.split("text", "\n"), line)
    return rows.select(
        "path", line.cast("long").alias("line_no"), T.match_col("text", F.col("x.start")).alias("col"), get(0).alias("rule_id"), get(1).alias("severity"), F.concat(F.lit("CWE-"), get(2).cast("string")).alias("cwe"),
        F.concat(get(3), F.lit(":2021")).alias("owasp"), get(4).alias("category"), get(6).alias("title"), T.snippet(own).alias("snippet"), F.lit("medium").alias("confidence"), F.lit("rule").alias("source"), (F.col("x.i") + 900).alias("rule_seq"),
    )


#: Whole-text forms of patterns whose line form isn't a call with `.*` in it.
ACROSS = {"CFG-CORS-CRED-001": r"credentials\s*[:=]\s*true[^;)]*[\"']\*[\"']|[\"']\*[\"'][^;)]*credentials\s*[:=]\s*true"}


def across(rule: Rule) -> str:
    """The rule's pattern for a whole text: `^` and `$` at every line, a call's arguments up to the first closing bracket, on any line."""
    return "(?im)" + ACROSS.get(rule.rule_id, rule.pattern.replace(r"\(.*", r"\([^)]*"))


def crosses(rule: Rule) -> bool:
    """Whether a match can hold a line feed: by blanks or a negated class beyond the character before a word."""
    return any(x in across(rule).replace("(^|[^0-9A-Za-z_])", "") for x in (r"\s", r"\W", r"\D", "[^"))


def _stop(rule: Rule) -> str:
    """What comes after a match and may still excuse it: the rest of the tag, statement or call."""
    return "^[^>]*" if rule.family == "HTML" else "^[^;]*" if rule.family == "SQL" else "^[^)]*"


def file_scan(files: DataFrame, catalog: Catalog | None = None, depth: int = 2, filters: bool = True, **of) -> DataFrame:
    """The rule scan of (path, language, text): a row for each rule and line where a match begins, whether it ends there or not.

    Rules without an exclusion are matched line by line, and over whole texts for what goes on in the next lines. Rules with one
    are matched over whole texts only: what excludes a match may stand in a later line of the same call. No shuffle.
    """
    catalog = catalog or Catalog()
    rules = catalog.of(depth, **of)
    single = D.rule_scan(to_lines(files), catalog, depth, filters, [(i, r) for i, r in rules if not r.unless])
    wide = [(i, r) for i, r in rules if r.unless or crosses(r)]
    if not wide:
        return single
    guarded = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: T.long_line_guard(x)), "\n")
    own = files.select("path", "language", guarded.alias("text"))
    text = F.col("text")
    found = D.tried(own, wide, "path", "text", pattern=across)
    spark = files.sparkSession
    forms = spark.createDataFrame([(i, across(r), "(?i)" + r.pattern, "(?i)" + r.unless if r.unless else None, _stop(r), r.need) for i, r in wide], "rule_seq int, _across string, _line string, _unless string, _stop string, _need string")
    dim = catalog.table(spark).select("rule_seq", "rule_id", "severity", "cwe", "owasp", "category", "title", "confidence")
    found = found.join(F.broadcast(forms), "rule_seq").where(F.lower(text).contains(F.col("_need"))).where(F.rlike(text, F.col("_across")))
    wanted = matches(text, F.col("_across"), lambda x: F.col("_unless").isNotNull() | F.trim(x, F.lit(" \t\r\n")).contains("\n"))
    found = found.withColumn("_m", F.explode_outer(wanted)).where("_m is not null")
    # A match may begin with the line feed before a word; its place is that of its first other character.
    start = F.col("_m.start") + F.length("_m.text") - F.length(F.ltrim("_m.text", F.lit(" \t\r\n")))
    found = found.withColumn("_start", start).withColumn("_no", T.match_line_no("text", F.col("_start")))
    line = F.col("_text")
    found = found.withColumn("_text", F.element_at(F.split("text", "\n", -1), F.col("_no"))).where(F.trim("_text") != "")
    rest = F.coalesce(F.regexp_substr(F.substring(text, F.col("_m.start") + F.length("_m.text") + 1, F.length(text)), F.col("_stop")), F.lit(""))
    excused = F.rlike(line, F.col("_unless")) | F.rlike(F.concat(F.col("_m.text"), rest), F.col("_unless"))
    found = found.where(F.when(F.col("_unless").isNull(), ~F.rlike(line, F.col("_line"))).otherwise(~excused))
    if filters:
        found = found.where(~D.is_comment(line) & ~D.is_definition(line))
    # One row for a line and rule: of matches that begin in one line, the first.
    found = found.withColumn("_head", F.substring(text, F.col("_start") - T.match_col("text", F.col("_start")) + 1, T.match_col("text", F.col("_start"))))
    found = found.where(F.col("_unless").isNull() | ~F.rlike(F.col("_head"), F.col("_line"))).join(F.broadcast(dim), "rule_seq")
    if filters:
        found = found.where(~D.is_safe_context(line, F.col("category")))
        if depth < 3:
            found = found.where(~D.is_test_path(F.col("path")) | (F.col("severity") == "critical"))
    return single.unionByName(found.select("path", F.col("_no").cast("long").alias("line_no"), T.match_col("text", F.col("_start")).alias("col"), "rule_id", "severity", "cwe", "owasp", "category", "title", T.snippet(line).alias("snippet"), "confidence", F.lit("rule").alias("source"), "rule_seq"))
