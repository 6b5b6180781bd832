"""Regex search queries over whole page text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import limits
from ..functions import dialect
from ..operators import grep
from . import corpus as c
from .registry import Registry

queries = Registry()

BASE = c.with_views(c.ENTRIES, c.LINES)
SEARCHED = "NOT deleted AND status = 'extracted'"


def hits(pattern: str, where: str = SEARCHED) -> str:
    return f"""{BASE}, hits AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, namespace, path ORDER BY page, line) AS rk
  FROM doc_lines WHERE {where} AND regexp_matches(line_text, '{pattern}', 'i'))"""


@queries.add(
    "grep_capped",
    hits("th[ae]t? [a-z]+ing") + """
SELECT tenant_id, namespace, path, page, line, substr(line_text, 1, 300) AS text FROM hits WHERE rk <= 3""",
)
def _capped(spark, d):
    found = grep.grep(c.entries(spark, d), c.pages(spark, d), r"th[ae]t? [a-z]+ing", max_matches_per_file=3)
    return found.select("tenant_id", "namespace", "path", "page", "line", "text")


CONTEXT_SQL = hits("stion the|de la") + """
SELECT h.tenant_id, h.namespace, h.path, h.page, h.line, substr(h.line_text, 1, 300) AS text,
       coalesce((SELECT string_agg(substr(l.line_text, 1, 300), chr(10) ORDER BY l.line) FROM doc_lines l
        WHERE l.entry_id = h.entry_id AND l.page = h.page AND l.line BETWEEN h.line - 2 AND h.line - 1), '') AS before,
       coalesce((SELECT string_agg(substr(l.line_text, 1, 300), chr(10) ORDER BY l.line) FROM doc_lines l
        WHERE l.entry_id = h.entry_id AND l.page = h.page AND l.line BETWEEN h.line + 1 AND h.line + 2), '') AS after
FROM hits h WHERE rk <= 10"""


@queries.add(
    "grep_all_context",
    CONTEXT_SQL.replace("substr(h.line_text, 1, 300)", "h.line_text")
    .replace("substr(l.line_text, 1, 300)", "l.line_text")
    .replace("WHERE rk <= 10", "WHERE h.path GLOB 'src*.md'"),
)
def _all_context(spark, d):
    found = grep.grep(
        c.entries(spark, d), c.pages(spark, d), "stion the|de la", "src*.md", context_lines=2, line_chars=None
    )
    return found.select(
        "tenant_id", "namespace", "path", "page", "line", "text",
        F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"),
    )


@queries.add("grep_context", CONTEXT_SQL)
def _context(spark, d):
    most = limits.GREP_MATCHES_PER_FILE
    found = grep.grep(
        c.entries(spark, d), c.pages(spark, d), "stion the|de la", context_lines=2, max_matches_per_file=most
    )
    return found.select(
        "tenant_id", "namespace", "path", "page", "line", "text",
        F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"),
    )


@queries.add(
    "grep_literal",
    hits("license", SEARCHED + " AND content_type LIKE 'text/%'") + """
SELECT tenant_id, namespace, path, page, line, substr(line_text, 1, 300) AS text FROM hits WHERE rk <= 10""",
)
def _literal(spark, d):
    most = limits.GREP_MATCHES_PER_FILE
    found = grep.grep(
        c.entries(spark, d), c.pages(spark, d), "license", content_type="text/", max_matches_per_file=most
    )
    return found.select("tenant_id", "namespace", "path", "page", "line", "text")


@queries.add(
    "grep_all",
    hits("th[ae]t? [a-z]+ing") + """
SELECT tenant_id, namespace, path, page, line, line_text AS text FROM hits""",
)
def _all(spark, d):
    found = grep.grep(c.entries(spark, d), c.pages(spark, d), r"th[ae]t? [a-z]+ing", line_chars=None)
    return found.select("tenant_id", "namespace", "path", "page", "line", "text")


@queries.add(
    "grep_files",
    hits("[0-9]{3}-[0-9]{4}", SEARCHED + " AND path GLOB 'src*.md'") + """
SELECT DISTINCT tenant_id, namespace, path FROM hits""",
)
def _files(spark, d):
    return grep.grep_files(c.entries(spark, d), c.pages(spark, d), "[0-9]{3}-[0-9]{4}", path_glob="src*.md")


BUDGET = dict(max_files=40, max_matches=60, max_matches_per_file=4, byte_budget=90_000)


def budget_sql(files_only: bool) -> str:
    per_file = 1 if files_only else BUDGET["max_matches_per_file"]
    full = "false" if files_only else f"mprior >= {BUDGET['max_matches']}"
    return f"""{BASE}, cand AS (
  SELECT * FROM (SELECT tenant_id, namespace, path, row_number() OVER (PARTITION BY tenant_id, namespace ORDER BY path) AS fno
                 FROM entries WHERE {SEARCHED}) WHERE fno <= {BUDGET['max_files']} + 1),
page_hits AS (
  SELECT l.tenant_id, l.namespace, l.path, l.page, sum(strlen(line_text) + 1)::BIGINT - 1 AS bytes,
         count(*) FILTER (regexp_matches(line_text, 'th[ae] [a-z]+ing', 'i')) AS hits
  FROM doc_lines l JOIN cand c ON c.tenant_id = l.tenant_id AND c.namespace = l.namespace AND c.path = l.path AND c.fno <= {BUDGET['max_files']}
  GROUP BY ALL),
walk AS (
  SELECT *, coalesce(sum(hits) OVER (PARTITION BY tenant_id, namespace, path ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fprior
  FROM (SELECT * FROM page_hits UNION ALL SELECT tenant_id, namespace, path, 0, 0, 0 FROM cand WHERE fno <= {BUDGET['max_files']})),
sums AS (
  SELECT *, coalesce(sum(CASE WHEN page > 0 AND fprior < {per_file} THEN bytes ELSE 0 END) OVER w, 0) AS bprior,
         coalesce(sum(CASE WHEN page > 0 AND fprior < {per_file} THEN least(hits, {per_file} - fprior) ELSE 0 END) OVER w, 0) AS mprior
  FROM walk WINDOW w AS (PARTITION BY tenant_id, namespace ORDER BY path, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
state AS (SELECT *, bprior >= {BUDGET['byte_budget']} AS spent, {full} AS done FROM sums)"""


@queries.add(
    "grep_summary",
    budget_sql(False) + f"""
SELECT s.tenant_id, s.namespace, count(*) FILTER (page = 0 AND NOT spent AND NOT done) AS files_searched,
       bool_or((page = 0 AND (spent OR done)) OR (page > 0 AND fprior < 4 AND spent AND NOT done)) AS truncated,
       any_value(c.file_cap_hit) AS file_cap_hit
FROM state s JOIN (SELECT tenant_id, namespace, max(fno) > {BUDGET['max_files']} AS file_cap_hit FROM cand GROUP BY ALL) c
  ON c.tenant_id = s.tenant_id AND c.namespace = s.namespace GROUP BY ALL""",
)
def _summary(spark, d):
    return grep.grep_bounded(c.entries(spark, d), c.pages(spark, d), "th[ae] [a-z]+ing", **BUDGET)[1]


@queries.add(
    "grep_budget",
    budget_sql(False) + f"""
SELECT tenant_id, namespace, path, page, line, text FROM (
  SELECT l.tenant_id, l.namespace, l.path, l.page, l.line, substr(l.line_text, 1, 300) AS text,
         row_number() OVER (PARTITION BY l.tenant_id, l.namespace, l.path ORDER BY l.page, l.line) AS rk_file,
         s.fprior, s.mprior, s.spent,
         row_number() OVER (PARTITION BY l.tenant_id, l.namespace, l.path, l.page ORDER BY l.line) AS rk_page
  FROM doc_lines l JOIN state s ON s.tenant_id = l.tenant_id AND s.namespace = l.namespace AND s.path = l.path AND s.page = l.page
  WHERE regexp_matches(l.line_text, 'th[ae] [a-z]+ing', 'i'))
WHERE NOT spent AND rk_file <= 4 AND mprior + rk_page <= {BUDGET['max_matches']}""",
)
def _budget(spark, d):
    found = grep.grep_bounded(c.entries(spark, d), c.pages(spark, d), "th[ae] [a-z]+ing", **BUDGET)[0]
    return found.select("tenant_id", "namespace", "path", "page", "line", "text")


@queries.add(
    "grep_budget_files",
    budget_sql(True) + """
SELECT tenant_id, namespace, path FROM state WHERE page > 0 AND hits > 0 AND fprior < 1 AND NOT spent""",
)
def _budget_files(spark, d):
    return grep.grep_bounded(
        c.entries(spark, d), c.pages(spark, d), "th[ae] [a-z]+ing", files_with_matches=True, **BUDGET
    )[0]


@queries.add(
    "python_regex",
    """SELECT doc_id, n, line_text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS n FROM documents)
WHERE regexp_matches(line_text, '([a-z]+)[.]([0-9]{2})@(mail[0-9])[.]')""",
)
def _dialect(spark, d):
    from ..functions import text as tx

    docs = c.table(spark, d, "documents")
    lines = tx.explode_once(docs, ["doc_id"], tx.split_lines(F.col("text")), "line_text", position="_n")
    regex = dialect.python_regex(r"(?P<user>[a-z]+)[.](?P<number>[0-9]{2})@(?P<host>mail[0-9])[.]")
    return lines.where(F.col("line_text").rlike(regex)).select(
        "doc_id", (F.col("_n") + 1).alias("n"), "line_text"
    )
