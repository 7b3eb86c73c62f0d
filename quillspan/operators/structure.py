"""Outlines, anchors, sections and statistics over records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slug(text: str | Column) -> Column:
    """The anchor of a heading's plain text."""
    t = F.col(text) if isinstance(text, str) else text
    for a, b in (("---", "—"), ("--", "–"), (r"\.\.\.", "…")):
        t = F.regexp_replace(t, a, b)
    t = F.regexp_extract(t, r"(?s)(\p{L}.*)", 1)
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"[^\p{L}\p{N}_\-. ]", "")
    t = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " ", "-"), "-+", "-"), "^-|-$", ""))
    return F.when(t == "", "section").otherwise(t)


def headings(records: DataFrame) -> DataFrame:
    """Headings with unique anchors: a repeated base gets -1, -2, ... in order, whatever else is called so."""
    h = records.where((F.col("kind") == "heading") & (F.col("depth") == 0)).withColumn("base", slug("plain"))
    n = F.row_number().over(Window.partitionBy("doc_id", "base").orderBy("start")) - 1
    return h.withColumn("slug", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))))


def outline(records: DataFrame, max_level: int = 6) -> DataFrame:
    return headings(records).where(F.col("level") <= max_level).select("doc_id", "line", "level", F.col("plain").alias("text"), "slug")


def sections(records: DataFrame, doc_bytes: DataFrame) -> DataFrame:
    """(doc_id, slug, level, start, end): a section ends at the next heading of its level or above, else with the document.

    One window a document: the headings of a document, which are few, are looked at as an array.
    """
    h = headings(records)
    per = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "level", "slug", "line"))).alias("hs"))
    rows = per.select("doc_id", "hs", F.posexplode("hs").alias("i", "h"))
    later = F.filter(F.slice("hs", F.col("i") + 2, F.size("hs")), lambda x: x["level"] <= F.col("h.level"))
    rows = rows.select("doc_id", F.col("h.slug").alias("slug"), F.col("h.level").alias("level"), F.col("h.line").alias("line"), F.col("h.start").alias("start"), F.get(later, F.lit(0))["start"].alias("next"))
    return rows.join(doc_bytes, "doc_id").select("doc_id", "slug", "level", "line", "start", F.coalesce("next", "bytes").alias("end"))


def bytes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))


def annotate(records: DataFrame, sections_: DataFrame) -> DataFrame:
    """Depth-0 blocks with the slugs of the sections around them, outermost first: an interval join within a document."""
    s = sections_.select(F.col("doc_id").alias("d"), F.col("start").alias("s0"), F.col("end").alias("s1"), F.col("slug").alias("sl"))
    blocks = records.where("depth = 0 AND kind <> 'gap'")
    inside = (F.col("doc_id") == F.col("d")) & (F.col("start") >= F.col("s0")) & (F.col("start") < F.col("s1")) & ~((F.col("kind") == "heading") & (F.col("start") == F.col("s0")))
    hit = blocks.join(s, inside, "left").groupBy("doc_id", "seq", "kind", "form", "protected", "line", F.col("start"), F.col("end"))
    return hit.agg(F.array_sort(F.collect_list(F.when(F.col("s0").isNotNull(), F.struct("s0", "sl")))).alias("a")).withColumn("ancestors", F.transform("a", lambda x: x["sl"])).drop("a")


def filter_blocks(annotated: DataFrame, heads: DataFrame, kinds: Sequence[str] = (), forms: Sequence[str] = (), protected: bool | None = None, under: str | None = None) -> DataFrame:
    """Conjunctive filters; `under` includes the heading itself."""
    out = annotated.join(heads.select("doc_id", "start", F.col("slug").alias("own")), ["doc_id", "start"], "left")
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if forms:
        out = out.where(F.col("form").isin(*forms))
    if protected is not None:
        out = out.where(F.col("protected") == protected)
    if under is not None:
        out = out.where(F.array_contains("ancestors", under) | (F.col("own") == under))
    return out


def slice_bytes(text: str | Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int")), "UTF-8")


def section_text(docs: DataFrame, sections_: DataFrame, slug_: str) -> DataFrame:
    first = sections_.where(F.col("slug") == slug_).groupBy("doc_id").agg(F.min_by(F.struct("start", "end"), "start").alias("s"))
    return docs.join(first, "doc_id").select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), slice_bytes("text", F.col("s.start"), F.col("s.end")).alias("section"))


def stats(records: DataFrame) -> DataFrame:
    """(doc_id, kind, n) of depth-0 blocks."""
    return records.where("depth = 0 AND kind <> 'gap'").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def hidden_fences(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Containers whose bytes hold a fence that has no record of its own."""
    c = records.where("depth = 0 AND kind IN ('list', 'block_quote')").join(docs.select("doc_id", "text"), "doc_id").drop(records["text"])
    body = slice_bytes("text", F.col("start"), F.col("end"))
    return c.where(body.contains("```") | body.contains("~~~")).select("doc_id", "kind", "line")


def as_json(records: DataFrame) -> DataFrame:
    """One JSON object a record; fields that don't apply are left out."""
    return records.select("doc_id", "seq", F.to_json(F.struct(*[c for c in records.columns if c not in ("doc_id", "path", "seq")])).alias("json"))


def line_kinds(rows: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind) of every line; a line of no block is BLANK. A range join within a document."""
    b = records.where("depth = 0 AND kind <> 'gap'").select(F.col("doc_id").alias("d"), F.col("line").alias("a"), F.col("end_line").alias("b"), F.col("kind").alias("k"))
    hit = rows.join(b, (F.col("doc_id") == F.col("d")) & F.col("line_no").between(F.col("a"), F.col("b")), "left")
    return hit.select("doc_id", "line_no", F.coalesce("k", F.lit("BLANK")).alias("kind"))


def total_spans(records: DataFrame, doc_bytes: DataFrame) -> DataFrame:
    """Documents whose depth-0 records aren't contiguous from 0 to the end; empty when the parser keeps its word."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    r = records.where("depth = 0").withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    bad = r.groupBy("doc_id").agg(F.sum((F.col("before") != F.col("start")).cast("int")).alias("breaks"), F.max("end").alias("last"))
    return bad.join(doc_bytes, "doc_id").where("breaks > 0 OR last <> bytes").select("doc_id")
