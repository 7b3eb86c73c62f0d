"""Queries of repairs, editorial passes and lints."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quillspan.operators import rewrite as W
from quillspan.operators.spread import spread
from quillspan.plans import recipes as R

BASE = W.Options(required=False)


def _lines(options, before, after, rule):
    """A line for each part, written with its key; the SQL has the line as it should become."""

    def run(spark, d):
        p = spread(R.table(spark, d, "part").select("p_partkey"))
        docs = p.select(F.col("p_partkey").cast("bigint").alias("doc_id"), F.replace(F.lit(before), F.lit("{k}"), F.col("p_partkey").cast("string")).alias("text"))
        return W.rewrite_documents(docs, options).select("doc_id", "text", F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["rule"]))), ",").alias("rules"))

    text = "'" + after.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return run, f"SELECT p_partkey AS doc_id, replace({text}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS text, '{rule}' AS rules FROM part"


def _nfc(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("é"), F.lit("e\u0301")).alias("text"))
    return W.rewrite_documents(docs, replace(BASE, nfc=True)).select("doc_id", F.sha2("text", 256).alias("digest"))


def _dirty(spark, d):
    return W.rewrite_documents(R.dirty(spark, d), replace(W.CANONICAL, heading=False))


def entries():
    C = W.CANONICAL
    out = {
        "f03_atx_space": _lines(W.Options(), "#T{k}\n\n#  Two\n", "# T{k}\n\n# Two\n", "heading.atx-space"),
        "f02_blank_after": _lines(W.Options(), "- a{k}\n# H\n", "- a{k}\n\n# H\n", "list.blank-after"),
        "f04_marker_column": _lines(W.Options(), "A. Smith {k}\nB. Jones\n", "A.  Smith {k}\nB.  Jones\n", "list.marker-column"),
        "f05_bullet_style": _lines(replace(BASE, editorial=True), "* a{k}\n* b\n", "- a{k}\n- b\n", "list.bullet-style"),
        "f06_heading_emphasis": _lines(replace(BASE, editorial=True), "# **T{k}** x\n", "# T{k} x\n", "heading.emphasis"),
        "f07_bold_colon": _lines(replace(BASE, editorial=True), "**T{k}**: x\n", "**T{k}:** x\n", "emphasis.bold-colon"),
        "f08_arrow_aside": _lines(replace(BASE, editorial=True, chicago_punct=True), "a{k} → b\n", "a{k}—b\n", "punct.arrow-aside"),
        "f09_quote_space": _lines(replace(BASE, editorial=True), ">q{k}\n", "> q{k}\n", "blockquote.space"),
        "f10_emdash": _lines(replace(BASE, chicago_punct=True), "word{k} -- next, run --flag, x — y\n", "word{k}—next, run --flag, x—y\n", "chicago.emdash-spacing"),
        "f11_ellipsis": _lines(replace(BASE, chicago_punct=True), "so{k}. . . and....\n", "so{k}… and…\n", "chicago.ellipsis"),
        "f12_sentence_space": _lines(replace(BASE, chicago_punct=True), "End{k}.  Next!   Go.\n", "End{k}. Next! Go.\n", "chicago.sentence-space"),
        "f13_space_before": _lines(replace(BASE, chicago_punct2=True), "a{k} , b ; c .\n", "a{k}, b; c.\n", "chicago.space-before-punct"),
        "f14_space_after": _lines(replace(BASE, chicago_punct2=True), "key{k} a,b and c:D 1,2\n", "key{k} a, b and c: D 1,2\n", "chicago.space-after-punct"),
        "f15_quote_punct": _lines(replace(BASE, chicago_punct2=True), 'He {k} "said". Then "left".\n', 'He {k} "said." Then "left."\n', "chicago.quote-terminal-punct"),
        "f16_abbrev_comma": _lines(replace(BASE, chicago_abbrev=True), "So {k}, e.g. this, i.e. that\n", "So {k}, e.g., this, i.e., that\n", "chicago.abbrev-comma"),
        "f17_etal": _lines(replace(BASE, chicago_abbrev=True), "By X{k} et al and Y et al.\n", "By X{k} et al. and Y et al.\n", "chicago.etal-period"),
        "f18_code_is_kept": _lines(C, "Use `a -- b{k}`  here.\n", "Use `a -- b{k}`  here.\n", ""),
        "f19_footnote_ref": _lines(replace(BASE, footnote=True), "See[^ n{k} ].\n", "See[^n{k}].\n", "footnote.ref-format"),
        "f20_footnote_def": _lines(replace(BASE, footnote=True), "[^ n{k} ]:   body\n", "[^n{k}]: body\n", "footnote.def-format"),
        "f21_heading_canonical": _lines(replace(BASE, heading=True), "# T{k} ##\n", "# T{k}\n", "heading.canonical"),
        "f22_fence_canonical": _lines(replace(BASE, fence=True), "```  py{k}  \nx\n```   \n", "```py{k}\nx\n```\n", "fence.canonical"),
        "f23_autolink": _lines(replace(BASE, safe_links=True), "See http://h/{k}.\n", "See <http://h/{k}>.\n", "link.autolink-bare"),
        "f24_scrivener": _lines(replace(BASE, scrivener=True), "#\nT{k}\n", "# T{k}\n", "heading.scrivener-split"),
        "f25_trailing": _lines(replace(BASE, whitespace=True), "a{k}    \nb \n", "a{k}  \nb\n", "whitespace.trailing"),
        "f26_wrap": _lines(replace(BASE, wrap=20), "aaaa bbbb cccc dddd eeee ffff {k}\n", "aaaa bbbb cccc dddd\neeee ffff {k}\n", ""),
        "f30_line_endings": _lines(BASE, "a{k}\r\nb\r\n", "a{k}\nb\n", ""),
    }
    out["f27_nfc"] = (_nfc, "SELECT doc_id, sha256(nfc_normalize(replace(text, chr(233), 'e' || chr(769)))) AS digest FROM documents")
    out["f01_required"] = (lambda spark, d: W.hits(W.rewrite_documents(R.dirty(spark, d))).select("doc_id", "rule"), "SELECT s_suppkey AS doc_id, unnest(list_concat(CASE WHEN s_suppkey % 2 = 0 THEN ['heading.atx-space'] ELSE [] END, CASE WHEN s_suppkey % 3 = 0 THEN ['list.blank-before'] ELSE [] END)) AS rule FROM supplier")
    out["f29_fixed_point"] = (
        lambda spark, d: _dirty(spark, d).select("doc_id", "text", F.col("settled").cast("int").alias("settled")),
        "SELECT s_suppkey AS doc_id, '# ' || s_name || chr(10) || chr(10) || 'Intro:' || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || '> quoted' || chr(10) || chr(10) || 'End.' || chr(10) AS text, 1 AS settled FROM supplier",
    )
    out["f31_canonical_gate"] = (lambda spark, d: W.canonical_gate(R.dirty(spark, d)), "SELECT s_suppkey AS doc_id, CAST(s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AS INTEGER) AS verdict FROM supplier")
    out["d08_summary"] = (lambda spark, d: W.summary(_dirty(spark, d)).groupBy("rule").agg(F.sum("n").alias("n")), "SELECT rule, count(*) AS n FROM (SELECT unnest(list_concat(list_concat(CASE WHEN s_suppkey % 2 = 0 THEN ['heading.atx-space'] ELSE [] END, CASE WHEN s_suppkey % 3 = 0 THEN ['list.blank-before'] ELSE [] END), list_concat(CASE WHEN s_suppkey % 5 = 0 THEN ['blockquote.space'] ELSE [] END, CASE WHEN s_suppkey % 7 = 0 THEN ['whitespace.trailing'] ELSE [] END))) AS rule FROM supplier) GROUP BY rule")
    out["d04_non_nfc"] = (
        lambda spark, d: W.lint_documents(R.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("é"), F.lit("e\u0301")).alias("text")), BASE).where("rule = 'unicode.non-nfc'").groupBy("doc_id").agg(F.count("*").alias("n")),
        "SELECT doc_id, len(list_filter(string_split(replace(text, chr(233), 'e' || chr(769)), chr(10)), lambda s: nfc_normalize(s) <> s)) AS n FROM documents WHERE nfc_normalize(replace(text, chr(233), 'e' || chr(769))) <> replace(text, chr(233), 'e' || chr(769))",
    )
    out["d05_unterminated"] = (lambda spark, d: W.lint_documents(R.fences(spark, d)), "SELECT c_custkey AS doc_id, 'fence.unterminated' AS rule, 3 AS line FROM customer WHERE c_custkey % 3 = 0")
    lint = lambda text, o: (lambda spark, d: W.lint_documents(R.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), text(F.col("n_nationkey")).alias("text")), o))
    out["d02_serial_comma"] = (lint(lambda k: F.when(k % 2 == 0, "Red, white and blue.\n").otherwise("Red, white, and blue.\n"), replace(BASE, serial_comma=True)), "SELECT n_nationkey AS doc_id, 'chicago.serial-comma' AS rule, 1 AS line FROM nation WHERE n_nationkey % 2 = 0")
    out["d03_number_style"] = (lint(lambda k: F.when(k % 3 == 0, "We saw 3 ships.\n").when(k % 3 == 1, "Chapter 3 has 5 km.\n").otherwise("On May 3 at 3:30, 7%.\n"), replace(BASE, number_style=True)), "SELECT n_nationkey AS doc_id, 'chicago.number-style' AS rule, 1 AS line FROM nation WHERE n_nationkey % 3 = 0")
    out["d06_marker_ambiguous"] = (lint(lambda k: F.when(k % 2 == 0, "A. Smith came.\n").otherwise("He came.\nA. Smith too.\n"), BASE), "SELECT n_nationkey AS doc_id, 'list.marker-ambiguous' AS rule, 1 AS line FROM nation WHERE n_nationkey % 2 = 0")
    return out
