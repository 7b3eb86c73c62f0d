"""Queries of the line family: every predicate over all lines of `documents` and the spelled lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import patterns as P
from quillspan.operators import lines as L
from quillspan.plans.recipes import LINES_SQL, spelled, spelled_sql, table


def _re(p: str) -> str:
    return "'" + P.re2(p.removeprefix("(?U)")).replace("'", "''").replace("\t", r"\t").replace("\n", r"\n").replace("\x0b", r"\x0b").replace("\f", r"\f").replace("\r", r"\r") + "'"


def _predicate(name):
    must, mustnt = L.PREDICATES[name]
    sql = f"SELECT doc_id, line_no FROM {spelled_sql()} WHERE regexp_matches(text, {_re(must)})" + (f" AND NOT regexp_matches(text, {_re(mustnt)})" if mustnt else "")
    return (lambda spark, d: spelled(spark, d).where(L.matches(name)).select("doc_id", "line_no")), sql


def _values(name, col, sql):
    """A computed value of every line that has one."""
    return name, ((lambda spark, d: spelled(spark, d).select("doc_id", "line_no", col().alias("value")).where("value IS NOT NULL")), f"SELECT doc_id, line_no, {sql} AS value FROM {spelled_sql()} WHERE ({sql}) IS NOT NULL")


LEAD = r"regexp_extract(text, '^([ \t]*)', 1)"
INDENT = f"list_reduce(list_prepend(0, list_transform(string_split({LEAD}, ''), lambda c: CASE WHEN c = chr(9) THEN -1 WHEN c = ' ' THEN 1 ELSE 0 END)), lambda n, c: CASE WHEN c = -1 THEN n + 4 - n % 4 ELSE n + c END)"
WORD = r"upper(regexp_extract(text, '^[ \t]*\(?([MDCLXVI]+|[mdclxvi]+)[.)]', 1))"


def _count(p):
    return f"len(regexp_extract_all({WORD}, '{p}'))"


ROMAN = (
    f"CASE WHEN {WORD} <> '' AND regexp_matches({WORD}, '^{P.ROMAN_BODY}$') THEN CAST(1000 * {_count('M')} + 500 * {_count('D')} + 100 * {_count('C')} + 50 * {_count('L')} + 10 * {_count('X')} + 5 * {_count('V')} + {_count('I')}"
    f" - 200 * {_count('C[MD]')} - 20 * {_count('X[CL]')} - 2 * {_count('I[XV]')} AS INTEGER) END"
)
HTML = "CASE " + " ".join(f"WHEN regexp_matches(text, {_re(p)}) THEN '{k}'" for k, p in P.HTML_KINDS.items()) + " END"
MARK = (  # written from the rules, not from the table of patterns
    r"CASE WHEN regexp_matches(text, '^[ \t]*[-*+]') THEN regexp_extract(text, '^[ \t]*([-*+])', 1)"
    r" WHEN regexp_matches(text, '^[ \t]*(\(([0-9]+|#)\)|([0-9]+|#)[.)])') THEN regexp_extract(text, '^[ \t]*(\([0-9#]+\)|[0-9#]+[.)])', 1)"
    r" WHEN regexp_matches(text, '^[ \t]*(\(@[\p{L}\p{N}_-]*\)|@[\p{L}\p{N}_-]*[.)])') THEN regexp_extract(text, '^[ \t]*(\(@[\p{L}\p{N}_-]*\)|@[\p{L}\p{N}_-]*[.)])', 1)"
    rf" WHEN regexp_matches(text, '^[ \t]*(\([A-Za-z]\)|[A-Za-z][.)])') OR coalesce({ROMAN}, 0) > 0 AND regexp_matches(text, '^[ \t]*(\([A-Za-z]+\)|[A-Za-z]+[.)])') THEN regexp_extract(text, '^[ \t]*(\([A-Za-z]+\)|[A-Za-z]+[.)])', 1) END"
)
AFTER = "substr(text, length(" + LEAD + ") + length(mark) + 1)"


def _fold(blanks, start):
    return f"list_reduce(list_prepend({start}, list_transform(string_split({blanks}, ''), lambda c: CASE WHEN c = chr(9) THEN -1 WHEN c = ' ' THEN 1 ELSE 0 END)), lambda n, c: CASE WHEN c = -1 THEN n + 4 - n % 4 ELSE n + c END)"


WIDTH = _fold(rf"regexp_extract({AFTER}, '^([ \t]*)', 1)", f"({INDENT} + length(mark))") + f" - ({INDENT} + length(mark))"
EACH = f"(SELECT *, CASE WHEN width > 0 OR ended THEN CASE WHEN ended THEN 99 ELSE width END END AS sep, coalesce({ROMAN}, 0) AS value_ FROM (SELECT *, {WIDTH} AS width, regexp_matches({AFTER}, '^[ \\t]*$') AS ended, {INDENT} AS ind FROM (SELECT *, {MARK} AS mark FROM {spelled_sql()})))"
FANCY = r"coalesce(regexp_matches(mark, '^\(?[@A-Za-z]') AND sep >= CASE WHEN regexp_matches(mark, '^[A-Z]+\.$') AND (length(mark) = 2 OR value_ IN (1, 5, 10, 50, 100, 500, 1000)) THEN 2 ELSE 1 END AND NOT regexp_matches(text, '^[ \t]*p\. [0-9]'), false)"
LISTED = rf"(regexp_matches(text, '^[ \t]*[-*+]([ \t]|$)') OR regexp_matches(text, '^[ \t]*(\(([0-9]+|#)\)|([0-9]+|#)[.)])([ \t]|$)') OR {FANCY})"
HEAD = f"WHEN regexp_matches(text, {_re(P.BLANK)}) THEN 'BLANK' WHEN regexp_matches(text, {_re(P.FRONT_END)}) THEN 'FMATTER' WHEN regexp_matches(text, {_re(P.FENCE_OPEN)}) THEN 'FENCE' WHEN regexp_matches(text, {_re(P.ATX)}) THEN 'HEADING'"
BULLET = rf"regexp_matches(text, '^[ \t]*[-*+]([ \t]|$)') AND NOT regexp_matches(text, {_re(P.BREAK)})"
DECIMAL = r"regexp_matches(text, '^[ \t]*(\(([0-9]+|#)\)|([0-9]+|#)[.)])([ \t]|$)')"
EMPTY = r"regexp_matches(text, '^[ \t]*([-*+]|([0-9]+|#)[.)]|\(([0-9]+|#)\))[ \t]*$')"
SHAPE = "CASE WHEN mark LIKE '(%' THEN '()' ELSE right(mark, 1) END"
STYLE = rf"CASE WHEN {BULLET} THEN 'bullet' WHEN {DECIMAL} THEN 'decimal' || {SHAPE} WHEN mark LIKE '%@%' AND sep IS NOT NULL THEN 'example' || {SHAPE} WHEN {FANCY} THEN CASE WHEN value_ > 0 THEN 'roman' ELSE 'alpha' END || CASE WHEN regexp_matches(mark, '[A-Z]') THEN '-upper' ELSE '-lower' END || {SHAPE} END"
DOUBT = rf"regexp_matches(text, '^[ \t]*[A-Z]\. [^ ]') OR {FANCY} AND (regexp_matches(mark, '^\(?@[^.)]') OR regexp_matches(mark, '^[a-z][a-z]+[.)]$') AND value_ > 30)"


def _marked(name, col, sql):
    """As _values, of expressions over the line's marker."""
    return name, ((lambda spark, d: spelled(spark, d).select("doc_id", "line_no", col().alias("value")).where("value IS NOT NULL")), f"SELECT doc_id, line_no, value FROM (SELECT *, {sql} AS value FROM {EACH}) WHERE value IS NOT NULL")


def _marked_lines(name, col, sql):
    return name, ((lambda spark, d: spelled(spark, d).where(col()).select("doc_id", "line_no")), f"SELECT doc_id, line_no FROM {EACH} WHERE {sql}")


CLOSES = f"CASE WHEN ({HTML}) IS NOT NULL THEN CAST(CASE {HTML} " + " ".join(f"WHEN '{k}' THEN regexp_matches(regexp_replace(text, '^ *<', ''), {_re(p)})" for k, p in P.HTML_ENDS.items()) + " END AS INTEGER) END"


def entries():
    out = {n: _predicate(n) for n in L.PREDICATES}
    out |= dict(
        [
            _values("l03_indent", L.indent, f"CAST({INDENT} AS INTEGER)"),
            _marked("l04_separator", L.separator, "CAST(sep AS INTEGER)"),
            _marked_lines("l09_fancy_marker", L.fancy, FANCY),
            _marked_lines("l32_marker_doubt", L.doubtful, DOUBT),
            _values("l07_roman_value", L.roman, ROMAN),
            _marked("l11_list_style", L.style, STYLE),
            _marked("l16_line_class", L.line_class, f"CASE {HEAD} WHEN {BULLET} THEN 'BULLET' WHEN {DECIMAL} OR {FANCY} THEN 'ORDERED' ELSE 'TEXT' END"),
            _marked("l16_line_class_open", lambda: L.line_class(paragraph_open=True), f"CASE {HEAD} WHEN {EMPTY} THEN 'TEXT' WHEN {BULLET} THEN 'BULLET' WHEN {DECIMAL} THEN 'ORDERED' ELSE 'TEXT' END"),
            _values("l17_html_kind", L.html_kind, HTML),
            _values("l18_html_closes", lambda: F.when(L.html_kind().isNotNull(), L.html_closes().cast("int")), CLOSES),
            _marked("l20_content_column", L.content_column, f"CASE WHEN {LISTED} THEN CAST(ind + length(mark) + CASE WHEN ended THEN greatest(1, width) ELSE sep END AS INTEGER) END"),
        ]
    )
    out["l30_hard_break"] = (
        lambda spark, d: L.hard_breaks(spelled(spark, d)).select("doc_id", "line_no"),
        f"SELECT doc_id, line_no FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM {spelled_sql()}) WHERE regexp_matches(text, '[^ \\t] {{2,}}$') AND regexp_matches(nxt, '[^ \\t]')",
    )
    out["s01_lines"] = (
        lambda spark, d: L.lines(table(spark, d, "documents"), offsets=True).select("doc_id", "line_no", "start", F.octet_length("text").alias("n_bytes")),
        f"SELECT doc_id, line_no, CAST(coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(strlen(text) AS INTEGER) AS n_bytes FROM ({LINES_SQL})",
    )
    out["s01_refused"] = (
        lambda spark, d: L.refusals(table(spark, d, "documents")),
        "SELECT doc_id, 'long-line' AS reason FROM documents WHERE list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) > 8191",
    )
    return out
