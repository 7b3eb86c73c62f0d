"""Queries of links, repairs, terms, repository checks and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators.kept import kept
from quillspan.operators import blocks as B
from quillspan.operators import checks as C
from quillspan.operators import edits as E
from quillspan.operators import links as G
from quillspan.operators import terms as T
from quillspan.plans import recipes as R

TERMS = T.load([{"term": "database", "forbidden": ["data base"], "exempt": ["supplier-5.md"]}, {"term": "API", "expansion": "application interface", "case_sensitive": True}])
FM = [{"field": "title", "type": "string", "required": True}, {"field": "count", "type": "number"}]
SLUG = "replace(lower(n_name), ' ', '-')"


def _g(recipe, make, *cols):
    def run(spark, d):
        docs = recipe(spark, d)
        out = make(G.Graph(kept(B.records(docs))), docs)
        return out.selectExpr(*(cols or ("doc_id", "rule", "severity", "line")))

    return run


def _r(recipe, make, *cols):
    def run(spark, d):
        docs = recipe(spark, d)
        return make(B.records(docs), docs).selectExpr(*(cols or ("doc_id", "rule", "severity", "line")))

    return run


def _broken_titles(spark, d):
    """Nation documents whose link has a spelling error that one edit mends where key % 3 = 0, another case where key % 3 = 1."""
    n, k = R.table(spark, d, "nation"), F.col("n_nationkey")
    s = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    bad = F.when(k % 3 == 0, F.concat(s, F.lit("x"))).when(k % 3 == 1, F.upper(s)).otherwise("nothing-like-it-at-all")
    return n.select(k.cast("bigint").alias("doc_id"), F.format_string("nation-%d.md", "n_nationkey").alias("path"), F.concat(F.lit("# "), "n_name", F.lit("\n\n[t](#"), bad, F.lit(")\n")).alias("text"))


def _candidates(spark, d):
    docs = _broken_titles(spark, d)
    g = G.Graph(B.records(docs))
    return docs, G.anchor_candidates(g.broken_here(), g.anchors)


def _repaired(spark, d):
    docs, c = _candidates(spark, d)
    e = G.safe_edits(G.repair_edits(c, F.concat(F.lit("#"), "have")))
    return E.apply(e, docs).select("doc_id", "text")


def _moved(spark, d):
    """Documents that link to a file that now lies in a folder; for even keys there is one such file, for odd ones two."""
    n, k = R.table(spark, d, "nation"), F.col("n_nationkey")
    docs = n.select(k.cast("bigint").alias("doc_id"), F.format_string("nation-%d.md", "n_nationkey").alias("path"), F.format_string("[n](old/note-%d.md#top)\n", "n_nationkey").alias("text"))
    files = n.select(F.format_string("new/note-%d.md", "n_nationkey").alias("path")).unionByName(n.where(k % 2 == 1).select(F.format_string("other/note-%d.md", "n_nationkey").alias("path")))
    return G.moved_files(G.Graph(B.records(docs)).missing_files(files), files)


def _cites(spark, d):
    docs = R.citations(spark, d)
    keys = R.table(spark, d, "part").where("p_size > 25").select(F.lit("lib.bib").alias("source"), F.format_string("p%d", "p_partkey").alias("key"))
    named = docs.select("doc_id", F.lit("lib.bib").alias("source"))
    return C.unresolved_citations(B.records(docs), named, keys, keys.select("source").limit(0)).select("doc_id", "rule", "message")


def _bib(spark, d):
    p = R.table(spark, d, "part")
    src = p.select(F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 2 == 0, "bibtex").otherwise("csl-json").alias("format"), F.when(F.col("p_partkey") % 2 == 0, F.format_string("@book{k%d, title={x}}\n@string{s = 1}\n", "p_partkey")).otherwise(F.format_string('[{"id": "k%d"}]', "p_partkey")).alias("content"))
    return C.bib_keys(src)


def _check(spark, d):
    docs = R.cross_links(spark, d).unionByName(R.skips(spark, d).withColumn("path", F.concat(F.lit("skip/"), "path")).withColumn("doc_id", F.col("doc_id") + 5000)).unionByName(R.notes(spark, d).withColumn("doc_id", F.col("doc_id") + 100_000))
    rec = B.records(docs)
    return C.check(rec, docs, docs.select("path"), suppress=["check.anchor-*"])


def _precedence(spark, d):
    n, k = R.table(spark, d, "nation"), F.col("n_nationkey")
    docs = n.select(k.cast("bigint").alias("doc_id"), F.format_string("nation-%d.md", "n_nationkey").alias("path"), F.concat(F.lit("![a](img-"), k.cast("string"), F.lit(".png)\n"), F.when(k % 4 == 0, "\n```\nx\n").otherwise("")).alias("text"))
    files = docs.select("path").unionByName(n.where(k % 2 == 0).select(F.format_string("img-%d.png", "n_nationkey").alias("path")))
    rec = B.records(docs)
    return C.check(rec, docs, files, dialect=C.unterminated_fences(rec, "dialect.fence.unterminated", "warning")).select("doc_id", "rule")


def _images(spark, d):
    n, k = R.table(spark, d, "nation"), F.col("n_nationkey")
    docs = n.select(k.cast("bigint").alias("doc_id"), F.lit("x.md").alias("path"), F.when(k % 2 == 0, "![](a.png)\n").otherwise("![alt](a.png)\n").alias("text"))
    return C.image_alts(B.records(docs)).select("doc_id", "rule", "line")


def _math(spark, d):
    n, k = R.table(spark, d, "nation"), F.col("n_nationkey")
    docs = n.select(k.cast("bigint").alias("doc_id"), F.lit("x.md").alias("path"), F.when(k % 3 == 0, "A $$x$$ b.\n").when(k % 3 == 1, "A \\begin{x} b.\n").otherwise("A b.\n").alias("text"))
    return C.lossy_math(B.records(docs), docs).select("doc_id", "rule")


def _dup_defs(spark, d):
    n, k = R.table(spark, d, "nation"), F.col("n_nationkey")
    docs = n.select(k.cast("bigint").alias("doc_id"), F.lit("x.md").alias("path"), F.concat(F.lit("[a  B]: x\n"), F.when(k % 2 == 0, "[A b]: y\n").otherwise("[c]: y\n")).alias("text"))
    return C.duplicate_definitions(G.Graph(B.records(docs))).select("doc_id", "rule", "line")


def _front(spark, d):
    docs = R.front_matter(spark, d)
    return C.schema_findings(C.front_matter(B.records(docs, kinds=["frontmatter"]), docs), docs, FM).select("doc_id", "rule", "line")


def _edits(fn):
    return lambda spark, d: fn(*R.edits(spark, d))


def _levenshtein(spark, d):
    c = R.table(spark, d, "nation").select(F.col("n_name").alias("a")).crossJoin(R.table(spark, d, "nation").select(F.col("n_name").alias("b")))
    return c.select("a", "b", F.levenshtein("a", "b", 2).alias("distance"))


def _split(spark, d):
    c = R.table(spark, d, "part").select("p_partkey", F.concat(F.lit("doc"), F.col("p_partkey").cast("string"), F.lit(".md#a%20b+c")).alias("dest"))
    t, a = G.split_target(F.col("dest"))
    return c.select("p_partkey", t.alias("target"), a.alias("anchor"))


def _resolve(spark, d):
    c = R.table(spark, d, "part").select("p_partkey", F.format_string("a/b%d/c.md", "p_partkey").alias("base"), F.when(F.col("p_partkey") % 2 == 0, "../x.md").otherwise("./y/../z.md").alias("to"))
    return c.select("p_partkey", G.resolve(F.col("base"), F.col("to")).alias("path"))


def entries():
    f = "links.{0}"
    out = {}
    out["g07_broken_anchor"] = (_g(R.links, lambda g, docs: g.broken_here()), "SELECT n_nationkey AS doc_id, 'links.broken-anchor' AS rule, 'error' AS severity, 3 AS line FROM nation WHERE n_nationkey % 2 = 1")
    row = "CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER)"
    out["g08_missing_file"] = (_g(R.cross_links, lambda g, docs: g.missing_files(docs)), f"SELECT doc_id, 'links.missing-file' AS rule, 'error' AS severity, line FROM (SELECT n_nationkey AS k, n_regionkey + 1000 AS doc_id, {row} AS line FROM nation) WHERE k % 5 = 0")
    out["g09_broken_anchor_elsewhere"] = (_g(R.cross_links, lambda g, docs: g.broken_elsewhere(docs, docs)), f"SELECT doc_id, 'links.broken-anchor' AS rule, 'error' AS severity, line FROM (SELECT n_nationkey AS k, n_regionkey + 1000 AS doc_id, {row} AS line FROM nation) WHERE k % 5 > 0 AND k % 7 = 1")
    out["g10_undefined_reference"] = (_g(R.references, lambda g, docs: g.undefined_references(), "doc_id", "rule", "severity", "message"), "SELECT s_nationkey AS doc_id, 'links.undefined-reference' AS rule, 'error' AS severity, 'undefined [s' || s_suppkey || ']' AS message FROM supplier WHERE s_suppkey % 2 = 0 AND s_acctbal <= 0")
    out["g11_reference_destinations"] = (_g(R.references, lambda g, docs: g.named.join(g.definitions.select("doc_id", "key", F.col("destination").alias("goes_to")), ["doc_id", "key"]), "doc_id", "key", "goes_to"), "SELECT s_nationkey AS doc_id, 's' || s_suppkey AS key, 'http://h/' || s_suppkey AS goes_to FROM supplier WHERE s_suppkey % 2 = 0 AND s_acctbal > 0")
    out["g12_unused_definition"] = (_g(R.references, lambda g, docs: g.unused_definitions(), "doc_id", "rule", "message"), "SELECT s_nationkey AS doc_id, 'links.unused-definition' AS rule, '[s' || s_suppkey || '] is never used' AS message FROM supplier WHERE s_suppkey % 2 = 1 AND s_acctbal > 0")
    out["g13_undefined_footnote"] = (_g(R.notes, lambda g, docs: g.undefined_notes()), "SELECT c_custkey AS doc_id, 'links.undefined-footnote' AS rule, 'error' AS severity, unnest(CASE WHEN c_custkey % 7 = 0 THEN [1, 3] ELSE [1] END) AS line FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 13 <> 0")
    out["g14_reused_footnote"] = (_g(R.notes, lambda g, docs: g.reused_notes()), "SELECT c_custkey AS doc_id, 'links.reused-footnote' AS rule, 'error' AS severity, 3 AS line FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0")
    out["g15_unused_footnote"] = (_g(R.notes, lambda g, docs: g.unused_notes()), "SELECT c_custkey AS doc_id, 'links.unused-footnote' AS rule, 'warning' AS severity, 3 AS line FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 11 <> 0")
    out["g01_graph"] = (_g(R.links, lambda g, docs: g.anchors, "doc_id", "slug"), f"SELECT n_nationkey AS doc_id, {SLUG} AS slug FROM nation")
    out["g17_export"] = (_g(R.references, lambda g, docs: g.export().groupBy("doc_id", "part").agg(F.count("*").alias("n")), "doc_id", "part", "n"), "SELECT doc_id, part, count(*) AS n FROM (SELECT n_nationkey AS doc_id, 'anchor' AS part FROM nation UNION ALL SELECT s_nationkey, 'link' FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_nationkey, 'definition' FROM supplier WHERE s_acctbal > 0) GROUP BY ALL")
    out["g16_all_link_findings"] = (_g(R.notes, lambda g, docs: g.findings(docs).groupBy("rule").agg(F.count("*").alias("n")), "rule", "n"), "SELECT rule, count(*) AS n FROM (SELECT 'links.undefined-footnote' AS rule, unnest(CASE WHEN c_custkey % 7 = 0 THEN [1, 3] ELSE [1] END) FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 13 <> 0 UNION ALL SELECT 'links.reused-footnote', 1 FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 UNION ALL SELECT 'links.unused-footnote', 1 FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 11 <> 0) GROUP BY rule")
    out["g02_label_key"] = (lambda spark, d: R.table(spark, d, "part").select("p_partkey", G.label_key(F.concat(F.lit("  "), "p_name", F.lit("\t Z "))).alias("label_key")), "SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || chr(9) || ' Z ', '\\s+', ' ', 'g'))) AS label_key FROM part")
    out["g03_bare_destination"] = (lambda spark, d: R.table(spark, d, "part").select("p_partkey", G.bare(F.when(F.col("p_partkey") % 2 == 0, F.format_string('<a%d b> "t"', "p_partkey")).otherwise(F.format_string('a%d\\)b "t"', "p_partkey"))).alias("dest")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a' || p_partkey || ' b' ELSE 'a' || p_partkey || ')b' END AS dest FROM part")
    out["g04_split_target"] = (_split, "SELECT p_partkey, 'doc' || p_partkey || '.md' AS target, 'a b+c' AS anchor FROM part")
    out["g05_external"] = (lambda spark, d: R.table(spark, d, "pages").select("page_id", G.external(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?:/", ""))).cast("int").alias("external")), "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS external FROM pages")
    out["g06_resolve"] = (_resolve, "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a/x.md' ELSE 'a/b' || p_partkey || '/z.md' END AS path FROM part")
    out["g18_levenshtein"] = (_levenshtein, "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN levenshtein(a.n_name, b.n_name) <= 2 THEN CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) ELSE -1 END AS distance FROM nation a, nation b")
    out["g20_anchor_candidates"] = (lambda spark, d: _candidates(spark, d)[1].select("doc_id", "tier", "have", "confidence"), f"SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 3 = 0 THEN 3 ELSE 1 END AS tier, {SLUG} AS have, CASE WHEN n_nationkey % 3 = 0 THEN 'medium' ELSE 'high' END AS confidence FROM nation WHERE n_nationkey % 3 < 2")
    out["g21_moved_files"] = (lambda spark, d: _moved(spark, d).select("doc_id", "replacement", "n"), "SELECT n_nationkey AS doc_id, unnest(CASE WHEN n_nationkey % 2 = 1 THEN ['new/note-' || n_nationkey || '.md#top', 'other/note-' || n_nationkey || '.md#top'] ELSE ['new/note-' || n_nationkey || '.md#top'] END) AS replacement, 1 + n_nationkey % 2 AS n FROM nation")
    out["g22_repair_moved"] = (lambda spark, d: G.repair_edits(_moved(spark, d), F.col("replacement")).select("doc_id", "start", "end", "replacement"), "SELECT n_nationkey AS doc_id, 4 AS start, 4 + strlen('old/note-' || n_nationkey || '.md#top') AS \"end\", 'new/note-' || n_nationkey || '.md#top' AS replacement FROM nation WHERE n_nationkey % 2 = 0")
    out["g23_repaired"] = (_repaired, f"SELECT n_nationkey AS doc_id, '# ' || n_name || chr(10) || chr(10) || '[t](#' || CASE WHEN n_nationkey % 3 < 2 THEN {SLUG} ELSE 'nothing-like-it-at-all' END || ')' || chr(10) AS text FROM nation")
    out["t04_forbidden_terms"] = (_r(R.terms, lambda rec, docs: T.forbidden(rec, docs, TERMS), "doc_id", "rule", "line", "fixable"), "SELECT s_suppkey AS doc_id, 'terms.forbidden' AS rule, 3 AS line, unnest(CASE WHEN s_suppkey % 2 = 1 THEN [true, false] ELSE [false] END) AS fixable FROM supplier WHERE s_suppkey <> 5")
    out["t05_first_uses"] = (_r(R.terms, lambda rec, docs: T.first_uses(rec, docs, TERMS), "doc_id", "term", "cast(introduced as int) as introduced"), "SELECT s_suppkey AS doc_id, 'database' AS term, 0 AS introduced FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'API', CAST(s_suppkey % 3 = 0 AS INTEGER) FROM supplier")
    out["t07_undefined_acronym"] = (_r(R.terms, lambda rec, docs: T.undefined_acronyms(rec, docs, TERMS)), "SELECT s_suppkey AS doc_id, 'terms.undefined-acronym' AS rule, 'warning' AS severity, 12 AS line FROM supplier WHERE s_suppkey % 3 <> 0")
    out["t09_usage"] = (_r(R.terms, lambda rec, docs: T.usage(rec, docs, TERMS), "term", "size(used_in) as n_used", "size(introduced_in) as n_introduced"), "SELECT 'API' AS term, count(*) AS n_used, count(*) FILTER (s_suppkey % 3 = 0) AS n_introduced FROM supplier UNION ALL SELECT 'database', count(*), 0 FROM supplier WHERE s_suppkey % 2 = 0")
    out["t10_term_edits"] = (lambda spark, d: (lambda docs: E.apply(T.term_edits(T.forbidden(B.records(docs), docs, TERMS)), docs).select("doc_id", F.regexp_extract("text", "\nThe ([a-z ]+) is here", 1).alias("word")))(R.terms(spark, d)), "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey = 5 THEN 'data base' ELSE 'database' END AS word FROM supplier")
    out["t01_benchmark_terms"] = (lambda spark, d: R.table(spark, d, "documents").where(F.col("text").rlike(T.word_pattern("the"))).select("doc_id"), "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}\\p{M}_-])the($|[^\\p{L}\\p{N}\\p{M}_-])')")
    out["c01_heading_skip"] = (_r(R.skips, lambda rec, docs: C.heading_skips(rec)), "SELECT n_nationkey AS doc_id, 'check.heading-skip' AS rule, 'warning' AS severity, 3 AS line FROM nation WHERE n_nationkey % 4 = 0")
    out["c02_image_alt"] = (_images, "SELECT n_nationkey AS doc_id, 'check.image-alt' AS rule, 1 AS line FROM nation WHERE n_nationkey % 2 = 0")
    out["c04_fence_language"] = (_r(R.fences, lambda rec, docs: C.fence_languages(rec, docs)), "SELECT c_custkey AS doc_id, 'check.fence-language' AS rule, 'warning' AS severity, 3 AS line FROM customer WHERE c_custkey % 2 = 1")
    out["c05_unterminated_fence"] = (_r(R.fences, lambda rec, docs: C.unterminated_fences(rec)), "SELECT c_custkey AS doc_id, 'check.unterminated-fence' AS rule, 'error' AS severity, 3 AS line FROM customer WHERE c_custkey % 3 = 0")
    out["c06_duplicate_definition"] = (_dup_defs, "SELECT n_nationkey AS doc_id, 'check.duplicate-definition' AS rule, 2 AS line FROM nation WHERE n_nationkey % 2 = 0")
    out["c07_lossy_math"] = (_math, "SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 3 = 0 THEN 'check.lossy-math' ELSE 'check.lossy-latex' END AS rule FROM nation WHERE n_nationkey % 3 < 2")
    out["c08_anchor_collision"] = (_r(R.repeated, lambda rec, docs: C.anchor_collisions(rec), "doc_id", "message"), "SELECT min(n_regionkey) AS doc_id, '#' || slug || ' also at ' || string_agg('region-' || n_regionkey || '.md:' || line, ', ' ORDER BY 'region-' || n_regionkey || '.md') FILTER (n_regionkey > 0) AS message FROM (SELECT n_regionkey, CASE WHEN k = 1 THEN 'summary' ELSE 'summary-' || (k - 1) END AS slug, 8 * (k - 1) + 5 AS line FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)) GROUP BY slug HAVING count(*) > 1")
    out["c09_front_matter"] = (_front, """SELECT doc_id, rule, CAST(line AS INTEGER) AS line FROM (
        SELECT c_custkey AS doc_id, 'check.frontmatter-missing' AS rule, 1 AS line FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 2 = 1
        UNION ALL SELECT c_custkey, 'check.frontmatter-type', 2 + CAST(c_custkey % 2 = 0 AS INTEGER) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 0
        UNION ALL SELECT c_custkey, 'check.frontmatter-unknown', 3 + CAST(c_custkey % 2 = 0 AS INTEGER) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 = 0)""")
    out["c10_citations"] = (_cites, "SELECT p_partkey AS doc_id, 'check.unresolved-citation' AS rule, 'no entry for @p' || p_partkey AS message FROM part WHERE p_size <= 25")
    out["s09_bibliography"] = (_bib, "SELECT 'b' || p_partkey AS source, 'k' || p_partkey AS key FROM part")
    out["c12_precedence"] = (_precedence, "SELECT n_nationkey AS doc_id, unnest(list_concat(CASE WHEN n_nationkey % 2 = 1 THEN ['check.missing-asset'] ELSE [] END, CASE WHEN n_nationkey % 4 = 0 THEN ['check.fence-language', 'check.unterminated-fence'] ELSE [] END)) AS rule FROM nation")
    out["c14_repository_check"] = (lambda spark, d: _check(spark, d).groupBy("rule", "severity").agg(F.count("*").alias("n")), """SELECT rule, severity, count(*) AS n FROM (
        SELECT 'links.missing-file' AS rule, 'error' AS severity FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'links.broken-anchor', 'error' FROM nation WHERE n_nationkey % 5 > 0 AND n_nationkey % 7 = 1
        UNION ALL SELECT 'check.heading-skip', 'warning' FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'links.undefined-footnote', 'error' FROM (SELECT unnest(CASE WHEN c_custkey % 7 = 0 THEN [1, 3] ELSE [1] END) FROM customer WHERE c_custkey % 11 = 0 AND c_custkey % 13 <> 0)
        UNION ALL SELECT 'links.reused-footnote', 'error' FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 UNION ALL SELECT 'links.unused-footnote', 'warning' FROM customer WHERE c_custkey % 13 = 0 AND c_custkey % 11 <> 0) GROUP BY ALL""")
    out["e01_validate"] = (_edits(lambda docs, e: E.validate(e, docs).select("doc_id", "reason")), "SELECT s_suppkey AS doc_id, CASE WHEN s_suppkey % 10 = 0 THEN 'stale' END AS reason FROM supplier")
    out["e03_splice"] = (_edits(lambda docs, e: E.apply(E.validate(e, docs).where("reason IS NULL"), docs).select("doc_id", "text")), "SELECT s_suppkey AS doc_id, 'Name: ' || CASE WHEN s_suppkey % 10 = 0 THEN s_name ELSE 'S' || s_suppkey END || '.' || chr(10) || 'Key.' || chr(10) AS text FROM supplier")
    out["e05_hunks"] = (_edits(lambda docs, e: E.hunks(e, docs)), "SELECT s_suppkey AS doc_id, 1 AS first_line, 1 AS last_line, 1 AS n_edits, 'rename' AS rules FROM supplier")
    out["e06_stream"] = (_edits(lambda docs, e: E.as_stream(e, docs).where("n = 1").select("doc_id", F.get_json_object("json", "$.replacement").alias("replacement"))), "SELECT s_suppkey AS doc_id, 'S' || s_suppkey AS replacement FROM supplier")
    out["s11_read_edits"] = (_edits(lambda docs, e: E.read_edits(E.as_stream(e, docs).where("n > 0")).select("doc_id", "start", "replacement", "reason")), "SELECT s_suppkey AS doc_id, 6 AS start, 'S' || s_suppkey AS replacement, CAST(NULL AS VARCHAR) AS reason FROM supplier")
    return out
