"""Queries of the structure family over documents built from the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import blocks as B
from quillspan.operators import lines as L
from quillspan.operators import structure as S
from quillspan.plans import recipes as R

SLUG = "replace(lower({0}), ' ', '-')"
OUTLINE_ROWS = f"""
SELECT r_regionkey AS doc_id, 1 AS level, r_name AS text, {SLUG.format('r_name')} AS slug, 1 AS line, -1 AS k FROM region
UNION ALL
SELECT n_regionkey, 2, n_name, {SLUG.format('n_name')}, CAST(1 + 4 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER), n_nationkey FROM nation
"""
DOC_TEXT = """(SELECT r_regionkey AS doc_id, '# ' || r_name || chr(10) || chr(10) || 'Region ' || r_regionkey || '.' || chr(10) || chr(10) ||
 coalesce((SELECT string_agg('## ' || n_name || chr(10) || chr(10) || 'Nation ' || n_nationkey || '.' || chr(10) || chr(10), '' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey), '') AS text FROM region)"""


def _records(recipe, **kw):
    return lambda spark, d: B.records(recipe(spark, d), **kw)


def _sections(spark, d):
    docs = R.outline(spark, d)
    return S.sections(B.records(docs, kinds=["heading"], inlines=False), S.bytes_of(docs))


def _annotated(spark, d):
    docs = R.outline(spark, d)
    rec = B.records(docs, inlines=False)
    return S.annotate(rec, S.sections(rec, S.bytes_of(docs))), S.headings(rec)


def _hidden(spark, d):
    n = R.table(spark, d, "nation")
    k = F.col("n_nationkey")
    docs = n.select(k.cast("bigint").alias("doc_id"), F.lit("x.md").alias("path"), F.concat(F.when(k % 2 == 0, "- a\n  ```\n  x\n  ```\n").otherwise("> q\n> r\n"), F.when(k % 3 == 0, "\n> ~~~\n> x\n").otherwise("")).alias("text"))
    return S.hidden_fences(B.records(docs, inlines=False), docs)


def _totality(spark, d):
    docs = R.outline(spark, d)
    for k, more in enumerate((R.fences, R.lists, R.raw_html, R.front_matter, R.terms)):
        docs = docs.unionByName(more(spark, d).withColumn("doc_id", F.col("doc_id") + 10_000_000 * (k + 1)))
    return S.total_spans(B.records(docs), S.bytes_of(docs))


def entries():
    out = {}
    out["q04_outline"] = (lambda spark, d: S.outline(B.records(R.outline(spark, d), kinds=["heading"])), f"SELECT doc_id, line, level, text, slug FROM ({OUTLINE_ROWS})")
    out["q01_slugify"] = (
        lambda spark, d: R.table(spark, d, "part").select("p_partkey", S.slug("p_name").alias("slug")),
        "SELECT p_partkey, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM (SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(p_name, '\\p{L}.*'), '[^\\p{L}\\p{N}_\\-. ]', '', 'g'), ' ', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')) AS s FROM part)",
    )
    out["q02_assign_slugs"] = (
        lambda spark, d: S.headings(B.records(R.repeated(spark, d), kinds=["heading"])).select("doc_id", "slug"),
        f"SELECT n_regionkey AS doc_id, {SLUG.format('n_name')} AS slug FROM nation UNION ALL SELECT n_regionkey, CASE WHEN k = 0 THEN 'summary' ELSE 'summary-' || k END FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k FROM nation)",
    )
    out["q03_annotate"] = (
        lambda spark, d: _annotated(spark, d)[0].where("kind = 'paragraph'").select("doc_id", "line", F.array_join("ancestors", "/").alias("ancestors")),
        f"SELECT doc_id, line + 2 AS line, CASE WHEN level = 1 THEN slug ELSE (SELECT {SLUG.format('r_name')} FROM region WHERE r_regionkey = doc_id) || '/' || slug END AS ancestors FROM ({OUTLINE_ROWS})",
    )
    out["q05_filter_blocks"] = (
        lambda spark, d: S.filter_blocks(*_annotated(spark, d), kinds=["paragraph", "heading"], protected=False, under="nation_1").select("doc_id", "kind", "line"),
        f"SELECT doc_id, unnest(['heading', 'paragraph']) AS kind, unnest([line, line + 2]) AS line FROM ({OUTLINE_ROWS}) WHERE slug = 'nation_1'",
    )
    out["q06_section_span"] = (
        lambda spark, d: _sections(spark, d).select("doc_id", "slug", "start", "end"),
        f"""SELECT doc_id, slug, CAST(start AS BIGINT) AS start, CAST(coalesce(CASE WHEN level = 1 THEN NULL ELSE lead(start) OVER (PARTITION BY doc_id, level ORDER BY start) END, total) AS BIGINT) AS "end" FROM (
            SELECT o.doc_id, o.level, o.slug, instr(t.text, (CASE WHEN o.level = 1 THEN '# ' ELSE chr(10) || '## ' END) || o.text || chr(10)) - (CASE WHEN o.level = 1 THEN 1 ELSE 0 END) AS start, strlen(t.text) AS total FROM ({OUTLINE_ROWS}) o JOIN {DOC_TEXT} t USING (doc_id))""",
    )
    out["q07_section_text"] = (
        lambda spark, d: S.section_text(R.outline(spark, d), _sections(spark, d), "nation_1").select("doc_id", "section"),
        "SELECT n_regionkey AS doc_id, '## ' || n_name || chr(10) || chr(10) || 'Nation ' || n_nationkey || '.' || chr(10) || chr(10) AS section FROM nation WHERE lower(n_name) = 'nation_1'",
    )
    out["q08_stats"] = (
        lambda spark, d: S.stats(B.records(R.outline(spark, d), inlines=False)),
        "SELECT r_regionkey AS doc_id, unnest(['heading', 'paragraph']) AS kind, 1 + (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region",
    )
    out["q09_hidden_fence"] = (
        _hidden,
        "SELECT n_nationkey AS doc_id, 'list' AS kind, 1 AS line FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'block_quote', CASE WHEN n_nationkey % 2 = 0 THEN 6 ELSE 4 END FROM nation WHERE n_nationkey % 3 = 0",
    )
    out["q10_json"] = (
        lambda spark, d: S.as_json(B.records(R.skips(spark, d), kinds=["heading"]).select("doc_id", "path", "seq", "kind", "level", "text", "label")).select("doc_id", "json"),
        """SELECT n_nationkey AS doc_id, '{"kind":"heading","level":1,"text":"' || n_name || '"}' AS json FROM nation UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN '{"kind":"heading","level":3,"text":"Deep"}' ELSE '{"kind":"heading","level":2,"text":"Next"}' END FROM nation""",
    )
    out["q11_line_kinds"] = (
        lambda spark, d: S.line_kinds(L.lines(R.outline(spark, d)), B.records(R.outline(spark, d), inlines=False)).groupBy("doc_id", "kind").count().withColumnRenamed("count", "n"),
        "SELECT r_regionkey AS doc_id, unnest(['heading', 'paragraph', 'BLANK']) AS kind, unnest([1 + c, 1 + c, 2 + 2 * c]) AS n FROM (SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS c FROM region)",
    )
    rec = lambda kinds: (lambda recipe: (lambda spark, d: B.records(recipe(spark, d), kinds=kinds)))
    pick = lambda recipe, kinds, *cols: (lambda spark, d: rec(kinds)(recipe)(spark, d).selectExpr("doc_id", *cols))
    n_of = "(SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)"
    out["b02_code_fence"] = (pick(R.fences, ["code_fence"], "line", "end_line", "cast(unterminated as int) as open_end"), "SELECT c_custkey AS doc_id, 3 AS line, CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 5 END AS end_line, CAST(c_custkey % 3 = 0 AS INTEGER) AS open_end FROM customer")
    out["b04_raw_html"] = (
        pick(R.raw_html, ["raw_html"], "html_kind", "line", "end_line"),
        "SELECT n_nationkey AS doc_id, ['comment', 'cdata', 'processing', 'declaration', 'script'][n_nationkey % 5 + 1] AS html_kind, 3 AS line, CASE n_nationkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE CASE WHEN n_nationkey % 2 = 1 THEN 7 ELSE 5 END END AS end_line FROM nation",
    )
    out["b06_pipe_table"] = (pick(R.tables, ["table"], "form", "line", "end_line"), f"SELECT n_nationkey AS doc_id, 'pipe' AS form, 1 AS line, CAST(2 + {n_of} AS INTEGER) AS end_line FROM nation")
    out["b07_atx_heading"] = (pick(R.skips, ["heading"], "level", "plain", "style"), "SELECT n_nationkey AS doc_id, 1 AS level, n_name AS plain, 'atx' AS style FROM nation UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 3 ELSE 2 END, CASE WHEN n_nationkey % 4 = 0 THEN 'Deep' ELSE 'Next' END, 'atx' FROM nation")
    out["b10_definitions"] = (pick(R.references, ["reference_def"], "label", "destination"), "SELECT s_nationkey AS doc_id, 's' || s_suppkey AS label, 'http://h/' || s_suppkey AS destination FROM supplier WHERE s_acctbal > 0")
    out["b10_footnotes"] = (pick(R.notes, ["footnote_def"], "label"), "SELECT c_custkey AS doc_id, 'n' || c_custkey AS label FROM customer WHERE c_custkey % 11 <> 0")
    out["b11_list"] = (pick(R.lists, ["list"], "line", "end_line"), f"SELECT n_nationkey AS doc_id, 3 AS line, CAST(2 + {n_of} AS INTEGER) AS end_line FROM nation WHERE {n_of} > 0")
    out["b15_list_items"] = (
        lambda spark, d: rec(["paragraph"])(R.lists)(spark, d).where("depth = 1").groupBy("doc_id").agg(F.count("*").alias("n")),
        "SELECT s_nationkey AS doc_id, count(*) AS n FROM supplier GROUP BY s_nationkey",
    )
    out["b14_gaps"] = (_totality, "SELECT CAST(0 AS BIGINT) AS doc_id WHERE false")
    out["b01_front_matter"] = (pick(R.front_matter, ["frontmatter"], "line", "end_line"), "SELECT c_custkey AS doc_id, 1 AS line, 3 + CAST(c_custkey % 2 = 0 AS INTEGER) + CAST(c_custkey % 5 = 0 AS INTEGER) AS end_line FROM customer WHERE c_custkey % 7 <> 0")
    out["b12_block_quote"] = (pick(R.dirty, ["block_quote"], "line"), "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE 8 END AS line FROM supplier")
    out["b19_records"] = (lambda spark, d: B.records(R.table(spark, d, "documents").where("text <> ''")).groupBy("kind").agg(F.count("*").alias("n")), None)
    out["i05_links"] = (pick(R.links, ["link"], "destination", "form"), f"SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN '#' || {SLUG.format('n_name')} ELSE '#no-such-' || n_nationkey END AS destination, 'inline' AS form FROM nation")
    out["i07_reference_links"] = (pick(R.references, ["link"], "label", "form"), "SELECT s_nationkey AS doc_id, 's' || s_suppkey AS label, 'reference' AS form FROM supplier WHERE s_suppkey % 2 = 0")
    out["i08_footnote_refs"] = (
        lambda spark, d: rec(["footnote_ref"])(R.notes)(spark, d).groupBy("doc_id", "label").agg(F.count("*").alias("n")),
        "SELECT c_custkey AS doc_id, 'n' || c_custkey AS label, CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END AS n FROM customer WHERE c_custkey % 13 <> 0",
    )
    out["i09_citations"] = (pick(R.citations, ["citation"], "key", "mode"), "SELECT p_partkey AS doc_id, 'p' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN 'normal' ELSE 'in-text' END AS mode FROM part")
    out["i02_code_spans"] = (pick(R.terms, ["code_span"], "text", "line"), "SELECT s_suppkey AS doc_id, 'data base' AS text, 3 AS line FROM supplier")
    out["i12_emphasis"] = (
        lambda spark, d: B.records(R.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("doc_id"), F.concat(F.lit("A *"), F.replace("n_name", F.lit("_"), F.lit(" ")), F.lit("* and **b** but ***c*** and snake_case_x.\n")).alias("text")), kinds=["emphasis", "strong"]).select("doc_id", "kind", "text"),
        "SELECT n_nationkey AS doc_id, unnest(['emphasis', 'strong']) AS kind, unnest([replace(n_name, '_', ' '), 'b']) AS text FROM nation",
    )
    return out
