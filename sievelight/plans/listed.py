"""SQL of what a scan lists of whole Python files: findings of all detectors, merged and less what inline marks take away, anti-patterns, complex functions.

What parsing finds (taint, data flow, shapes of functions) is given as SQL; rules, secrets, marks and anti-patterns are looked for in the files' texts."""

from __future__ import annotations

from ..functions import dims
from ..operators import detect as D
from ..operators.file_rules import FILE_RULES, _stop, across, crosses
from ..sources.corpus import quoted as q
from . import line_queries as L

_PYTHON = [(i, r) for i, r in L.CATALOG.of(2) if {"*", "python"} & set(r.languages)]
_SAFE = f"category IN ({', '.join(map(q, D.SAFE_FOR))}) AND regexp_matches(text, {q(D.SAFE_CALL)})"
_KEEP = f"NOT ({_SAFE}) AND (NOT {L.TEST} OR severity = 'critical')"
_CATEGORY = "CASE cwe " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.CWE_CATEGORY.items()) + " ELSE 'code' END"
_LONG = "CASE WHEN length(x) > 2000 THEN repeat(' ', length(x)) ELSE x END"


def _matches(table: str, seq: int, rule: tuple, need: str, pattern: str, *more: str) -> str:
    """Texts in which a pattern matches: its matches (own) and what is between them (gap)."""
    rule_id, severity, cwe, category = rule
    where = f"contains(lower(text), {q(need)}) AND " if need else ""
    shown = ", ".join(f"{x} AS {c}" for c, x in zip(("line_pattern", "unless", "stop"), more, strict=False))
    return f"SELECT path, text, {q(rule_id)} AS rule_id, {q(severity)} AS severity, 'CWE-{cwe}' AS cwe, {q(category)} AS category, {seq} AS rule_seq, {shown}, regexp_extract_all(text, {q(pattern)}) AS own, regexp_split_to_array(text, {q(pattern)}) AS gap FROM {table} WHERE {where}regexp_matches(text, {q(pattern)})"


def _wide() -> str:
    """`wide`: rules with an exclusion, over whole texts, and what the others match beyond a line; one row for a line in which a match begins."""
    value = lambda v: q(v) if v else "CAST(NULL AS VARCHAR)"
    some = [(i, r) for i, r in _PYTHON if r.unless or crosses(r)]
    hits = " UNION ALL ".join(_matches("guarded", i, (r.rule_id, r.severity, r.cwe, r.category), r.need, across(r), q("(?i)" + r.pattern), value(r.unless and "(?i)" + r.unless), q(_stop(r))) for i, r in some)
    return f"""guarded AS MATERIALIZED (SELECT path, array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_LONG}), chr(10)) AS text FROM files),
wide_match AS (SELECT path, text AS whole, rule_id, severity, cwe, category, rule_seq, line_pattern, unless, stop, own[i] AS m, length(array_to_string(gap[:i], '')) + length(array_to_string(own[:i - 1], '')) AS began
  FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM ({hits})) WHERE unless IS NOT NULL OR contains(trim(own[i], chr(32) || chr(9) || chr(13) || chr(10)), chr(10))),
wide_line AS (SELECT *, string_split(substr(whole, 1, began + length(m) - length(ltrim(m, chr(32) || chr(9) || chr(13) || chr(10)))), chr(10)) AS upto FROM wide_match),
wide AS (SELECT path, CAST(len(upto) AS BIGINT) AS line_no, rule_id, severity, cwe, category, rule_seq FROM (SELECT *, string_split(whole, chr(10))[len(upto)] AS text FROM wide_line)
  WHERE trim(text) <> '' AND NOT {L.COMMENT} AND NOT {L.DEFINITION} AND {_KEEP}
  AND CASE WHEN unless IS NULL THEN NOT regexp_matches(text, line_pattern) ELSE NOT regexp_matches(text, unless) AND NOT regexp_matches(m || regexp_extract(substr(whole, began + length(m) + 1), stop), unless) AND NOT regexp_matches(upto[-1], line_pattern) END)"""


def _far() -> str:
    """`far`: something in a file without something else near it."""
    hits = []
    for i, (rule_id, severity, cwe, _, category, languages, _, pattern, near, away) in enumerate(FILE_RULES):
        if "python" in languages:
            hits.append(_matches("files", 900 + i, (rule_id, severity, cwe, category), "", "(?i)" + pattern, q("(?i)" + near) if near else "CAST(NULL AS VARCHAR)", str(away)))
    return f"""far AS (SELECT path, CAST(len(string_split(substr(text, 1, began), chr(10))) AS BIGINT) AS line_no, rule_id, severity, cwe, category, rule_seq
  FROM (SELECT *, own[i] AS m, length(array_to_string(gap[:i], '')) + length(array_to_string(own[:i - 1], '')) AS began FROM (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM ({" UNION ALL ".join(hits)})))
  WHERE line_pattern IS NULL OR NOT regexp_matches(substr(text, began + 1, length(m) + CAST(unless AS BIGINT)), line_pattern))"""


def listed(files: str, taint: str, flow: str, shapes: str) -> str:
    """path, line_no, rule_id, severity, kind. `files` is SQL of path, text; `taint` and `flow` of path, line_no, rule_id, severity, cwe; `shapes` of path, line, n_issues, refactor_priority."""
    single = " UNION ALL ".join(L._rule_sql(i, r, "usable") for i, r in _PYTHON if not r.unless)
    own = "path, line_no, rule_id, severity, cwe, category"
    return f"""WITH files AS MATERIALIZED ({files}), taint AS ({taint}), flow AS ({flow}), shapes AS ({shapes}),
lines AS MATERIALIZED (SELECT path, 'python' AS language, CAST(unnest(range(1, len(x) + 1)) AS BIGINT) AS line_no, unnest(x) AS text FROM (SELECT path, string_split(text, chr(10)) AS x FROM files)),
usable AS MATERIALIZED (SELECT * FROM lines WHERE length(text) <= 2000 AND trim(text) <> '' AND NOT {L.COMMENT} AND NOT {L.DEFINITION}),
single AS (SELECT {own}, rule_seq FROM ({single}) WHERE {_KEEP}), {_wide()}, {_far()}, {L.PROVIDER}, entropy AS (WITH {L._entropy_sql("lines", 4.0)}), {L._MARKS},
every AS MATERIALIZED (SELECT {own}, 'rule' AS source, 1000 + rule_seq AS seq FROM (SELECT * FROM single UNION ALL SELECT * FROM wide UNION ALL SELECT * FROM far)
  UNION ALL SELECT path, line_no, rule_id, severity, 'CWE-798', 'secrets', 'secret-scanner', 3000 FROM provider UNION ALL SELECT path, line_no, 'SECRET-HIGH-ENTROPY', 'high', 'CWE-798', 'secrets', 'entropy', 4000 FROM entropy
  UNION ALL SELECT path, line_no, rule_id, severity, cwe, {_CATEGORY}, 'taint', 0 FROM taint UNION ALL SELECT path, line_no, rule_id, severity, cwe, {_CATEGORY}, 'dataflow', 2000 FROM flow),
agreed AS (SELECT * FROM every e WHERE NOT (source = 'rule' AND EXISTS (SELECT 1 FROM every t WHERE t.source = 'taint' AND t.path = e.path AND t.line_no = e.line_no AND t.cwe = e.cwe))
  AND NOT (source = 'dataflow' AND EXISTS (SELECT 1 FROM every t WHERE t.source <> 'dataflow' AND t.path = e.path AND t.line_no = e.line_no AND t.cwe = e.cwe))),
told AS (SELECT * FROM agreed e WHERE NOT (source IN ('secret-scanner', 'entropy') AND EXISTS (SELECT 1 FROM agreed t WHERE t.source NOT IN ('secret-scanner', 'entropy') AND t.category = 'secrets' AND t.path = e.path AND t.line_no = e.line_no))),
merged AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY path, line_no, cwe, category ORDER BY seq, rule_id) = 1),
smells AS ({L.ORACLES["antipattern_scan"].replace(f"WITH {L.LINES}, ", "WITH ")})
SELECT path, line_no, rule_id, severity, 'finding' AS kind FROM merged f WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.path = f.path AND m.line_no = f.line_no AND (m.rule_id IS NULL OR m.rule_id = f.rule_id))
UNION ALL SELECT path, line_no, rule_id, severity, 'antipattern' FROM smells
UNION ALL SELECT path, line AS line_no, 'COMPLEXITY', CASE refactor_priority WHEN 'high' THEN 'medium' ELSE 'low' END, 'complexity' FROM shapes WHERE n_issues > 0"""
