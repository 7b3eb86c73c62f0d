"""Work that has to follow the input: rows that joins make, rows that are broadcast, tasks that a pass has."""

from __future__ import annotations

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillspan.functions import sql
from quillspan.operators import blocks, checks, inline, prose, rewrite
from quillspan.operators import spread as spreading
from quillspan.operators.spread import spread
from quillspan.plans import registry


def nodes(df):
    """The operators of a plan that has run, those of its adaptive stages too."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        out.append(p)
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return out


def rows_out(df, of: str) -> list[int]:
    """Rows that each operator whose name has this in it gave."""
    each = [p.metrics().get("numOutputRows") for p in nodes(df) if of in p.nodeName()]
    return [m.get().value() for m in each if m.isDefined()]


def test_citations_meet_only_their_own_entries(spark):
    n = 300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("d%d.md", "id").alias("path"), F.format_string("So @p%d says, as @p%d does.\n", "id", "id").alias("text"))
    named = docs.select("doc_id", F.explode(F.array(F.lit("a.bib"), F.lit("b.bib"))).alias("source")).where("doc_id <> 7")
    keys = spark.range(n).where("id % 3 > 0").select(F.when(F.col("id") % 2 == 0, "a.bib").otherwise("b.bib").alias("source"), F.format_string("p%d", "id").alias("key"))
    out = checks.unresolved_citations(blocks.records(docs), named, keys, keys.select("source").limit(0)).select("doc_id", "message")
    got = sorted(map(tuple, out.collect()))
    assert got == sorted((i, f"no entry for @p{i}") for i in range(n) if i % 3 == 0 for _ in "ab")
    assert max(rows_out(out, "Join")) <= 4 * n


def test_sentences_are_not_broadcast_to_their_synonyms(spark, tmp_path):
    spark.range(500).select("id").coalesce(1).write.parquet(path := str(tmp_path / "keys"))
    rows = spark.read.parquet(path).select("id", F.concat(F.lit("A quick and big test "), F.col("id").cast("string"), F.lit(".")).alias("sentence"))
    syn = spark.createDataFrame([("quick", "fast", 2.0, None), ("quick", "rapid", 1.0, None), ("big", "large", 3.0, None)], "word string, synonym string, weight double, flag string")
    out = prose.synonym_candidates(rows, syn, ["id"], k=4)
    got = [r.candidate for r in sorted(out.where("id = 3").collect(), key=lambda r: r["rank"])]
    assert got == ["A quick and large test 3.", "A fast and big test 3.", "A rapid and big test 3.", "A fast and large test 3."]
    assert len(out.collect()) == 2000 and max(rows_out(out, "BroadcastExchange"), default=0) <= 3


def test_short_rows_of_one_file_are_spread_over_the_cores(spark, tmp_path):
    spark.range(400).coalesce(1).write.parquet(path := str(tmp_path / "keys"))
    docs = spark.read.parquet(path).select(F.col("id").alias("doc_id"), F.format_string("#T%d\n", "id").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    sql.view(docs, "spread_docs")
    for made in (blocks.records(docs), rewrite.rewrite_documents(docs), rewrite.lint_documents(docs), spark.table("spread_docs")):
        assert made.rdd.getNumPartitions() >= 3 * cores
    sizes = [r["count"] for r in blocks.records(docs).where("kind = 'paragraph'").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 60
    assert spread(many := spark.range(0, 400, 1, 3 * cores)) is many
    assert spark.table("spread_docs").count() == 400


def test_row_groups_are_counted_and_not_splits_of_bytes(spark, tmp_path):
    """A file of one row group in many splits: the rows are all in one of them."""
    spark.range(400).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "a part" / "part.parquet"))
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        keys = spark.read.parquet(str(tmp_path / "a part" / "part.parquet"))
        assert keys.rdd.getNumPartitions() >= 3 * cores
        assert keys.groupBy(F.spark_partition_id()).count().count() == 1
        out = registry.queries()["f18_code_is_kept"](spark, str(tmp_path / "a part"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(sizes) == 400 and max(sizes) <= 60


def test_findings_are_made_once(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.format_string("d%d.md", "id").alias("path"), F.when(F.col("id") % 2 == 0, "#T\n\n```\nx\n").otherwise("# T\n").alias("text"))
    found = checks.check(blocks.records(docs), docs, docs.select("path"), dialect=checks.dialect(docs))
    assert found.where("rule = 'dialect.heading.atx-space'").count() == 20 == found.where("rule = 'check.unterminated-fence'").count()
    assert not found.where("rule = 'dialect.fence.unterminated'").count()
    assert not any("MapInArrow" in p.nodeName() for p in nodes(found))


def test_compared_metrics_join_a_row_a_document(spark):
    docs = spark.range(30).select("id", F.lit("One two three. Four five.").alias("text"))
    compared = prose.compare(prose.metrics(docs, "id"), prose.metrics(docs.where("id < 20"), "id"), "id")
    got = compared.collect()
    assert compared.columns == ["id", "metric", "before", "after", "change", "regressed"]
    assert len(got) == 20 * len(prose.DIRECTION) and not any(r.regressed or r.change for r in got)
    assert max(rows_out(compared, "Join")) == 20
    assert prose.metrics(docs.coalesce(1), "id").rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism


def test_tasks_are_those_of_the_executors_asked_for():
    """A session's first query is planned when two cores are registered at most."""
    told = [{"spark.master": "local-cluster[3,4,10240]"}, {"spark.cores.max": "12"}, {"spark.executor.instances": "3", "spark.executor.cores": "4"}, {"spark.master": "local[2]"}, {}]
    assert [spreading.cores(2, t.get) for t in told] == [12, 12, 12, 2, 2]
    assert spreading.cores(40, told[0].get) == 40


#: Queries whose texts are built from keys, and how many times they build them.
BUILT = {"e04_introduced_dirt": 2, "b16_lazy_quote": 1, "i13_scopes": 1, "b17_table_lines": 1, "f03_atx_space": 1, "f05_bullet_style": 1, "f18_code_is_kept": 1, "f06_heading_emphasis": 1}


@pytest.mark.parametrize("name", BUILT)
def test_keys_are_shuffled_and_not_their_texts(spark, name):
    out = registry.queries()[name](spark, "/root/testdata/sf0.001")
    laid = [p for p in nodes(out) if "Exchange" in p.nodeName() and "RoundRobin" in p.outputPartitioning().toString()]
    assert [p.output().size() for p in laid] == [1] * BUILT[name]


def test_a_text_is_parsed_once_a_change(monkeypatch):
    seen, parse = [], rewrite.B.parse
    monkeypatch.setattr(rewrite.B, "parse", lambda text, **kw: seen.append(text) or parse(text, **kw))
    kept = rewrite.rewrite("# Kept 1\n")
    made = rewrite.rewrite("#Made 1\n")
    assert (kept, made) == (("# Kept 1\n", [], True), ("# Made 1\n", [("heading.atx-space", 1)], True))
    assert seen == ["# Kept 1\n", "#Made 1\n", "# Made 1\n"]


def test_a_rewrite_asks_no_plain_text_of_headings(monkeypatch):
    asked, plain = [], rewrite.B.I.plain
    monkeypatch.setattr(rewrite.B.I, "plain", lambda s: asked.append(s) or plain(s))
    assert rewrite.rewrite("# **Made** 2\n", rewrite.Options(required=False, editorial=True)) == ("# Made 2\n", [("heading.emphasis", 1)], True)
    assert asked == []
    assert [r["plain"] for r in rewrite.B.parse("# **Made** 3\n") if r["kind"] == "heading"] == ["Made 3"] and asked == ["**Made** 3"]


def test_a_line_is_scanned_by_its_signs():
    """Places of a line without signs aren't stepped through: the tests of a place run once a sign."""
    asked = []

    class Line(str):
        def __getitem__(self, at):
            asked.append(at)
            return str.__getitem__(self, at)

    found = inline.scan(Line("word " * 500 + "[a](b) " + "word " * 500))
    assert [(x.kind, x.text, x.destination, x.start) for x in found] == [("link", "a", "b", 2500)]
    assert len(asked) < 100


def test_a_line_without_a_match_is_not_scanned(monkeypatch):
    asked, scan = [], rewrite.I.scan
    monkeypatch.setattr(rewrite.I, "scan", lambda s, *a: asked.append(s) or scan(s, *a))
    plain, code = "Keep `this` word\n", "Use `a -- b` here.\n"
    assert [rewrite.rewrite(t, rewrite.CANONICAL) for t in (plain, code)] == [(plain, [], True), (code, [], True)]
    assert asked == [code[:-1]]


@pytest.mark.parametrize("off", ["", "editorial", "chicago_punct", "chicago_punct2", "chicago_abbrev", "quote_punct", "arrow_aside"])
def test_patterns_of_a_line_are_asked_only_where_they_can_begin(off):
    """The same matches as those of the patterns one by one, over lines of their signs."""
    o = replace(rewrite.CANONICAL, **{off: False} if off else {})
    parts = [p for p in rewrite._SIGNS if f"{re.search('<[a-z]+>', p)[0]}" in rewrite.scanner(o).pattern]
    free, asked, pick = re.compile("|".join(parts)), rewrite.scanner(o), random.Random(15)
    pieces = [*" *→—-.,;:!?\"'”’)](eiaB1\u00e9_…", "**", "--", "  ", "...", ". . .", "et al", "e.g.", "i.e.", ".) ", '."  ', "\"."]
    found = lambda rx, s: [(m.span(), m.lastgroup) for m in rx.finditer(s)]
    lines = ["".join(pick.choices(pieces, k=pick.randint(1, 14))) for _ in range(20_000)]
    assert [s for s in lines if found(free, s) != found(asked, s)] == [] and sum(bool(found(asked, s)) for s in lines) > 1000
    assert asked.pattern.startswith("(?=[")
