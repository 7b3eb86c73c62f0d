"""Repairs that are applied and judged again, and reports to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators import blocks, edits, links, terms
from quillspan.operators.kept import kept


def link_suggestions(graph: links.Graph, files: DataFrame) -> DataFrame:
    """(doc_id, start, end, replacement, rule, n, ..) of broken links: each candidate with how many there are for its link."""
    cols = ["doc_id", "path", "rule", "severity", "line", "start", "end", "dest_start", "dest_end", "to", "n", "confidence"]
    near = links.anchor_candidates(graph.broken_here(), graph.anchors).select(*cols, F.concat(F.lit("#"), "have").alias("replacement"))
    moved = links.moved_files(graph.missing_files(files), files).withColumn("confidence", F.lit("high")).select(*cols, "replacement")
    return near.unionByName(moved)


def link_edits(graph: links.Graph, files: DataFrame) -> DataFrame:
    """Edits of the links that have one candidate, without clusters that overlap."""
    return links.safe_edits(links.repair_edits(link_suggestions(graph, files), F.col("replacement")))


def repair_links(docs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired documents, what is found in them when they are parsed again): a repair can uncover the next finding."""
    graph = links.Graph(kept(blocks.records(docs)))
    new = kept(edits.apply(link_edits(graph, files), docs))
    return new, links.Graph(kept(blocks.records(new))).findings(files, new.select("path"))


def repair_terms(docs: DataFrame, glossary: Sequence[terms.Term]) -> tuple[DataFrame, DataFrame]:
    """(documents with their forbidden spellings replaced, what is left)."""
    new = kept(edits.apply(terms.term_edits(terms.forbidden(kept(blocks.records(docs)), docs, glossary)), docs))
    return new, terms.forbidden(kept(blocks.records(new)), new, glossary)


# reports


def link_notes(suggestions: DataFrame) -> DataFrame:
    """(path, line, value): one note a broken link with candidates."""
    one = F.array_sort(F.collect_set("replacement"))
    s = suggestions.groupBy("path", "line", "start").agg(one.alias("c"))
    bare = ~F.col("c")[0].rlike(r"[\s()<>\\]")
    text = (
        F.when((F.size("c") == 1) & bare, F.concat(F.lit("perhaps "), F.col("c")[0], F.lit(" is meant")))
        .when(F.size("c") == 1, F.concat(F.lit("found "), F.col("c")[0], F.lit(", which can't be written bare")))
        .otherwise(F.concat(F.size("c").cast("string"), F.lit(" candidates: "), F.array_join("c", ", ")))
    )
    return s.select("path", "line", F.format_string("%s:%d: note: %s", "path", "line", text).alias("value"))


def term_hint(findings: DataFrame) -> DataFrame:
    """(value): how many findings there are and how many can be fixed; no row where there are none."""
    n = findings.agg(F.count("*").alias("n"), F.count_if("fixable").alias("k")).where("n > 0")
    return n.select(F.format_string("%d found, %d can be fixed", "n", "k").alias("value"))


def totals(findings: DataFrame) -> DataFrame:
    """(value): errors and warnings of a run; no row where there are none."""
    n = findings.agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") != "error").alias("w")).where("e + w > 0")
    return n.select(F.format_string("%d errors, %d warnings", "e", "w").alias("value"))
