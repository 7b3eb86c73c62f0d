"""Queries of repairs, judges, commands and block forms; texts are built by key, and the SQL says what has to come of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import sql
from quillspan.operators import blocks as B
from quillspan.operators import prose as Z
from quillspan.operators import checks, repair
from quillspan.operators import rewrite as W
from quillspan.operators import terms as T
from quillspan.operators.spread import spread
from quillspan.plans import commands
from quillspan.plans import recipes as R
from quillspan.plans.q_links import TERMS, _broken_titles
from quillspan.plans.q_rewrite import BASE, _lines


def forms(spark, d, *texts: str):
    """A document for each part, with the text of p_partkey modulo their number; {k} is the key."""
    p, k = spread(R.table(spark, d, "part").select("p_partkey")), F.col("p_partkey")
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), (k % len(texts) + 1).cast("int"))
    return p.select(k.cast("bigint").alias("doc_id"), F.format_string("part-%d.md", k).alias("path"), F.replace(text, F.lit("{k}"), k.cast("string")).alias("text"))


def _parsed(kinds, cols, *texts):
    return lambda spark, d: B.records(forms(spark, d, *texts), kinds=kinds).selectExpr("doc_id", *cols)


def by_key(n: int, rows: dict[int, list[tuple]], names: list[str]) -> str:
    """SQL of the rows that parts of each remainder should give; {k} is the key."""
    show = lambda v: "replace('" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{k}', CAST(p_partkey AS VARCHAR))" if isinstance(v, str) else str(v)
    parts = [f"SELECT p_partkey AS doc_id, {', '.join(f'{show(v)} AS {c}' for v, c in zip(r, names))} FROM part WHERE p_partkey % {n} = {m}" for m, rs in rows.items() for r in rs]
    return " UNION ALL ".join(parts)


def _dirt(spark, d):
    return W.introduces_dirt(forms(spark, d, "# T{k}\n", "# T{k}\n", "#T{k}\n"), forms(spark, d, "#T{k}\n", "# U{k}\n", "#T{k}\n\n# A\n")).select("doc_id")


def _left_links(spark, d):
    docs = _broken_titles(spark, d)
    return repair.repair_links(docs, docs.select("path"))[1].select("doc_id", "rule", "line")


def _left_terms(spark, d):
    return repair.repair_terms(R.terms(spark, d), TERMS)[1].select("doc_id", "line", F.col("fixable").cast("int").alias("fixable"))


def _probes(spark, d):
    k, n = F.col("p_partkey"), len(Z.PROBES)
    want = F.array(*[F.lit(p[2]) for p in Z.PROBES])[F.col("probe")]
    a = R.table(spark, d, "part").select(k.alias("judge"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("probe"))
    a = a.withColumn("accepted", F.when(F.col("judge") % 3 == 0, want).when(F.col("judge") % 3 == 1, F.lit(True)).when(F.col("probe") > 0, want))
    return Z.probe_report(a)


def _merged(spark, d):
    rows = lambda *x: R.table(spark, d, "part").select("p_partkey", F.posexplode(F.array(*[F.lit(c) for c in x])).alias("i", "candidate")).select("p_partkey", (F.col("i") + 1).alias("rank"), "candidate")
    return Z.merge_candidates(rows("b", "a"), rows("c", "a", "d"), ["p_partkey"])


def _seeded(spark, d):
    rows = R.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "We utilize it.").otherwise("However, they obtain more.").alias("sentence"))
    return Z.synonym_candidates(rows, Z.seed_synonyms(spark), ["p_partkey"], k=1000).where("NOT candidate RLIKE 'ven so|till' OR NOT candidate LIKE '%get%'").select("p_partkey", "candidate")


def _purged(spark, d):
    s = R.table(spark, d, "part").select(F.format_string("W%d", "p_partkey").alias("word"), F.when(F.col("p_partkey") % 4 == 0, "Prove").otherwise("show").alias("synonym"))
    return Z.purge_synonyms(s, ["prove", "w7"])


def _synced(spark, d):
    k = F.col("p_partkey")
    p = R.table(spark, d, "part")
    stored = p.select(F.format_string("t%d", k).alias("term"), F.when(k % 2 == 0, "manual").otherwise("glossary").alias("source"))
    return Z.sync_terms(stored, p.where(k % 3 == 0).select(F.format_string("t%d", k).alias("term")))


def _udtf(spark, d):
    sql.register(spark)
    sql.view(forms(spark, d, "# T{k}\n\nOne. Two.\n", "#X{k}\n"), "quillspan_forms")
    return spark.sql("SELECT f.doc_id, r.kind, r.line, md_slug(r.text) AS slug FROM quillspan_forms f, LATERAL md_records(f.text) r WHERE r.kind <> 'gap'")


def _scalars(spark, d):
    sql.register(spark)
    sql.view(forms(spark, d, "#X{k}\n", "One{k}. Two."), "quillspan_forms")
    return spark.sql("SELECT doc_id, md_fix(text) AS fixed, array_join(md_sentences(text), '|') AS sentences FROM quillspan_forms")


def _sorted_kinds(spark, d):
    return B.records(R.outline(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def _notes(spark, d):
    from quillspan.operators.links import Graph

    docs = _broken_titles(spark, d)
    return repair.link_notes(repair.link_suggestions(Graph(B.records(docs)), docs.select("path"))).select("value")


def _accepted(spark, d):
    p = R.table(spark, d, "part")
    return Z.preservation(p.select(F.col("p_name").alias("original"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("").alias("text")))


def _regressions(spark, d):
    before = forms(spark, d, "One two three. " * 4).select("doc_id", "text")
    m = lambda x: Z.metrics(x, "doc_id")
    return Z.report(Z.compare(m(before), m(before), "doc_id")).where("metric = 'mattr'").select("doc_id", "line")


def _listed(spark, d):
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(T.freeze_list(TERMS))], "i int, term string")
    return terms.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "term"))), lambda x: x["term"]), "|").alias("terms"))


def entries():
    out = {}
    where = ["line", "end_line"]
    out["b03_tables"] = (
        _parsed(["table"], ["form", *where], "+---+---+\n| a | {k} |\n+---+---+\n", "Name  Key\n----- ---\nx     {k}\ny     2\n", "---------\nName  Key\n----- ---\nx     {k}\n\ny     2\n---------\n", "Name {k}\n\n----- ---\n\nx\n"),
        by_key(4, {0: [("grid", 1, 3)], 1: [("simple", 1, 4)], 2: [("multiline", 1, 7)]}, ["form", *where]),
    )
    out["b05_indented_code"] = (
        _parsed(["code_indented"], where, "Text {k}.\n\n    code\n\n    more\n\n\nEnd.\n", "Text {k}.\n    text\n", "- item {k}\n\n      text\n\n          code\n", "# {k}\n    code\nText.\n"),
        by_key(4, {0: [(3, 5)], 3: [(2, 2)]}, where),
    )
    out["b08_setext_heading"] = (
        _parsed(["heading"], ["level", "plain", "style", *where], "Title {k}\n=====\n", "Two *{k}*\n--\n\nText.\n", "Text {k}\n\n===\n", "A\nB {k}\n===\n"),
        by_key(4, {0: [(1, "Title {k}", "setext", 1, 2)], 1: [(2, "Two {k}", "setext", 1, 2)]}, ["level", "plain", "style", *where]),
    )
    out["b09_thematic_break"] = (_parsed(["thematic_break"], ["line"], "a{k}\n\n* * *\n\nb\n", "a{k}\n\n-*-\n\n___\n", "a {k}\n***\nb\n"), by_key(3, {0: [(3,)], 1: [(5,)], 2: [(2,)]}, ["line"]))
    out["b13_paragraph"] = (
        _parsed(["paragraph"], where, "One {k}.\nTwo.\n\nThree.\n# H\n", "Text {k}\n> quote\n", "Text\n```\n{k}\n```\nMore {k}\nand more\n- item\n", "<pre>\n{k}\n</pre>\nText\n| a |\n"),
        by_key(4, {0: [(1, 2), (4, 4)], 1: [(1, 1)], 2: [(1, 1), (5, 6), (7, 7)], 3: [(4, 4)]}, where),
    )
    out["b16_lazy_quote"] = _lines(W.Options(chicago_punct=True), "> a -- b{k}\nlazy -- too\n\nx -- y\n", "> a -- b{k}\nlazy -- too\n\nx—y\n", "chicago.emdash-spacing")
    out["b17_table_lines"] = _lines(W.Options(chicago_punct=True), "| a -- b | {k} |\n|---|---|\n| d -- e | f |\n\nx -- y\n", "| a -- b | {k} |\n|---|---|\n| d -- e | f |\n\nx—y\n", "chicago.emdash-spacing")
    out["b19_all_records"] = (_sorted_kinds, "SELECT r_regionkey AS doc_id, unnest(['heading', 'paragraph', 'gap']) AS kind, unnest([1 + c, 1 + c, 2 + 2 * c]) AS n FROM (SELECT r_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS c FROM region)")
    auto = ["form", "destination"]
    out["i03_autolinks"] = (_parsed(["link"], auto, "See <http://h/{k}> and <a b:c>.\n", "Mail <m{k}@x.org>, not <tag> or < a@b>.\n"), by_key(2, {0: [("autolink", "http://h/{k}")], 1: [("autolink", "m{k}@x.org")]}, auto))
    span = ["start", "`end`", "cast(protected as int) as protected"]
    out["i04_inline_html"] = (_parsed(["raw_inline"], span, "A <b>x</b> 1 < 2.\n", "No <1> here.\n", "A<br/>b\n"), by_key(3, {0: [(2, 5, 1), (6, 10, 1)], 2: [(1, 6, 1)]}, ["start", '"end"', "protected"]))
    out["i10_citation_context"] = (
        _parsed(["citation"], ["key", "mode"], "See @a{k}, x@no.y and a.@no.\n", "(@b{k}) says so.\n", "@ex{k}. An example\n", "As [@c{k}; see @d{k}] has it.\n"),
        by_key(4, {0: [("a{k}", "in-text")], 3: [("c{k}", "normal"), ("d{k}", "normal")]}, ["key", "mode"]),
    )
    scopes = "[a]({k})\n\n# [b](2)\n\n- [c](3)\n\n| h [d](4) |\n|---|\n\n> [e](5)\n\n[^n]: [f](6)\n\n| [g](7)\n| line\n\n```\n[h](8)\n```\n\n    [i](9)\n"
    out["i13_scopes"] = (_parsed(["link"], ["text", "line"], scopes), by_key(1, {0: [("a", 1), ("b", 3), ("c", 5), ("d", 7), ("e", 10), ("f", 12)]}, ["text", "line"]))
    out["c11_dialect"] = (
        lambda spark, d: checks.dialect(R.dirty(spark, d)).select("doc_id", "rule", "severity", "line", "message"),
        "SELECT s_suppkey AS doc_id, 'dialect.heading.atx-space' AS rule, 'error' AS severity, 1 AS line, 'not canonical: one space after the signs of a heading' AS message FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'dialect.list.blank-before', 'error', 4, 'not canonical: blank line before a list' FROM supplier WHERE s_suppkey % 3 = 0",
    )
    out["e04_introduced_dirt"] = (_dirt, "SELECT p_partkey AS doc_id FROM part WHERE p_partkey % 3 = 0")
    out["e07_links_left"] = (_left_links, "SELECT n_nationkey AS doc_id, 'links.broken-anchor' AS rule, 3 AS line FROM nation WHERE n_nationkey % 3 = 2")
    out["e07_terms_left"] = (_left_terms, "SELECT s_suppkey AS doc_id, 3 AS line, 0 AS fixable FROM supplier WHERE s_suppkey <> 5")
    closers = lambda spark, d: forms(spark, d, "and then {k}.”", "“and {k}.”", "so {k}.)")
    out["p03_closers"] = (lambda spark, d: closers(spark, d).select("doc_id", Z.closed("text", F.lit("later.")).alias("text")), by_key(3, {0: [("later.”",)], 1: [("later.",)], 2: [("later.)",)]}, ["text"]))
    out["p04_reconstruct"] = (
        lambda spark, d: forms(spark, d, "One {k}. Two!  Three?\n", "  One {k}. Two.").select("doc_id", Z.rebuilt("text", F.when(F.col("doc_id") % 4 < 2, F.array(F.lit(2))), F.when(F.col("doc_id") % 4 < 2, F.array(F.lit("New.")))).alias("text")),
        by_key(4, {0: [("One {k}. New.  Three?\n",)], 1: [("  One {k}. New.",)], 2: [("One {k}. Two!  Three?\n",)], 3: [("  One {k}. Two.",)]}, ["text"]),
    )
    out["p09_merge_candidates"] = (_merged, "SELECT p_partkey, unnest([1, 2, 3]) AS rank, unnest(['b', 'a', 'c']) AS candidate FROM part")
    verdicts = ('{"accept": true, "reason": "r{k}"}', '{"accept": "true", "reason": "r"}', '<think>{"accept": true}</think>no', 'So {"accept": false}, then {"accept": true, "meta": {"accept": false}}', '[{"accept": true}]', '```json\n{"accept": false, "reason": null}\n```', '{"accept": 1}', "{")
    out["p15_judged"] = (
        lambda spark, d: forms(spark, d, *verdicts).select("doc_id", Z.judged("text").alias("j")).selectExpr("doc_id", "cast(j.accepted as int) as accepted", "j.reason as reason"),
        by_key(8, {0: [(1, "r{k}")], 1: [(0, "r")], 2: [(0, "no verdict")], 3: [(1, "")], 4: [(0, "no verdict")], 5: [(0, "")], 6: [(0, "")], 7: [(0, "no verdict")]}, ["accepted", "reason"]),
    )
    out["p16_generated"] = (
        lambda spark, d: forms(spark, d, '["a{k}", " b ", "a{k}", "", "c", "d"]', "- a{k}\n2. b\n\n* c", "```JSON\n[\"x\"]\n```").select("doc_id", F.array_join(Z.generated("text"), "|").alias("candidates")),
        by_key(3, {0: [("a{k}|b|c",)], 1: [("a{k}|b|c",)], 2: [("x",)]}, ["candidates"]),
    )
    out["p17_probes"] = (_probes, "SELECT p_partkey AS judge, CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 4 END AS n_right, CASE p_partkey % 3 WHEN 0 THEN 'sound' WHEN 1 THEN 'rubber stamp' ELSE '4 of 5 right' END AS verdict FROM part")
    out["s13_seeded"] = (
        _seeded,
        "SELECT p_partkey, unnest(CASE WHEN p_partkey % 2 = 0 THEN ['We use it.', 'We employ it.'] ELSE ['Still, they obtain more.', 'Even so, they obtain more.', 'However, they get more.'] END) AS candidate FROM part",
    )
    out["p20_purge"] = (_purged, "SELECT 'W' || p_partkey AS word, 'show' AS synonym FROM part WHERE p_partkey % 4 <> 0 AND p_partkey <> 7")
    out["p20_sync"] = (_synced, "SELECT 't' || p_partkey AS term, CASE WHEN p_partkey % 3 = 0 THEN 'glossary' ELSE 'manual' END AS source FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0")
    out["m09_preservation"] = (_accepted, "SELECT count(*) AS n, round(avg(CASE WHEN p_partkey % 2 = 0 AND trim(p_name) <> '' THEN 1.0 ELSE 0 END), 6) AS mean_similarity FROM part")
    out["m10_report"] = (_regressions, "SELECT p_partkey AS doc_id, 'mattr            0.2500 -> 0.2500' AS line FROM part")
    out["x05_flags"] = (
        lambda spark, d: commands.run("fix", forms(spark, d, "#T{k} ##\n\nx -- y  \n", "* a{k}. . . b\n"), ["--canonical", "--spaced-emdash"]).select("doc_id", "text"),
        by_key(2, {0: [("# T{k}\n\nx — y\n",)], 1: [("- a{k}… b\n",)]}, ["text"]),
    )
    out["x06_records"] = (_udtf, by_key(2, {0: [("heading", 1, "t{k}"), ("paragraph", 3, None)], 1: [("paragraph", 1, None)]}, ["kind", "line", "slug"]).replace("None AS slug", "NULL AS slug"))
    out["x06_scalars"] = (_scalars, by_key(2, {0: [("# X{k}\n", "#X{k}")], 1: [("One{k}. Two.", "One{k}.|Two.")]}, ["fixed", "sentences"]))
    out["x07_link_notes"] = (_notes, "SELECT 'nation-' || n_nationkey || '.md:3: note: perhaps #' || replace(lower(n_name), ' ', '-') || ' is meant' AS value FROM nation WHERE n_nationkey % 3 < 2")
    out["x07_totals"] = (
        lambda spark, d: repair.totals(commands.run("check", forms(spark, d, "#T{k}\n", "# T{k}\n\n### Deep{k}\n"), forms(spark, d, "").select("path"))),
        "SELECT count(*) FILTER (p_partkey % 2 = 0) || ' errors, ' || count(*) FILTER (p_partkey % 2 = 1) || ' warnings' AS value FROM part",
    )
    return out
