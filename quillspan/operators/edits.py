"""Edits of byte spans: read, validated, ordered, applied and shown as hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES, CONFIDENCES = ("fix", "warning", "error"), ("low", "medium", "high")
SCHEMA = "start bigint, `end` bigint, replacement string, expect string, rule string, severity string, confidence string, explanation string"
MOST = 100_000


def read_edits(lines: DataFrame) -> DataFrame:
    """Edits from (doc_id, n, json) lines: flat objects alone; (.., reason) is set where a line isn't one."""
    nested = F.col("json").rlike(r'[:,\[]\s*[\[{]')
    e = lines.withColumn("e", F.from_json("json", SCHEMA)).where(F.get_json_object("json", "$.schema").isNull())
    bad = F.when(nested, "nested value").when(F.col("e.start").isNull() | F.col("e.end").isNull() | F.col("e.replacement").isNull(), "not an edit").when(F.col("n") > MOST, "too many edits")
    return e.select("doc_id", F.col("n").alias("edit_no"), "e.*", bad.alias("reason"))


def _bytes(c: str | Column) -> Column:
    return F.encode(c, "UTF-8")


def _boundary(raw: Column, at: Column, size: Column) -> Column:
    """Whether a byte place isn't inside a character."""
    return (at == size) | ~F.conv(F.hex(F.substring(raw, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)


def validate(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """edits with a reason where one can't be applied; an edit that overlaps an earlier one, a stale one and one outside its document can't."""
    d = docs.select("doc_id", _bytes("text").alias("__b"))
    e = edits.join(d, "doc_id", "left").withColumn("__size", F.octet_length("__b"))
    w = Window.partitionBy("doc_id").orderBy("start", "end", *(["edit_no"] if "edit_no" in edits.columns else []))
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    now = F.substring(F.col("__b"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    ok_words = lambda c, words: F.col(c).isNull() | F.col(c).isin(*words) if c in edits.columns else F.lit(True)
    reason = (
        F.when(F.col("__b").isNull(), "no document").when((F.col("start") < 0) | (F.col("end") < F.col("start")) | (F.col("end") > F.col("__size")), "out of bounds")
        .when(~_boundary(F.col("__b"), F.col("start"), F.col("__size")) | ~_boundary(F.col("__b"), F.col("end"), F.col("__size")), "inside a character")
        .when(F.coalesce(reach, F.lit(0)) > F.col("start"), "overlap").when(~ok_words("severity", SEVERITIES), "unknown severity").when(~ok_words("confidence", CONFIDENCES), "unknown confidence")
    )
    if "expect" in edits.columns:
        reason = reason.when(F.col("expect").isNotNull() & (_bytes("expect") != now), "stale")
    return e.withColumn("reason", reason).drop("__b", "__size")


def ordered(edits: DataFrame) -> DataFrame:
    return edits.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("start", "end", *(["edit_no"] if "edit_no" in edits.columns else []))))


def apply(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """docs (doc_id, path, text) with valid, non-overlapping edits spliced in; a document without any is returned as it is."""
    e = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("es"))
    d = docs.join(e, "doc_id", "left").withColumn("__b", _bytes("text"))
    n = F.size("es")
    piece = lambda a, b: F.decode(F.substring(F.col("__b"), a.cast("int") + 1, (b - a).cast("int")), "UTF-8")
    kept = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(piece(F.when(i == 1, F.lit(0).cast("bigint")).otherwise(F.element_at("es", F.when(i > 1, i - 1).otherwise(1))["end"]), F.element_at("es", i)["start"]), F.element_at("es", i)["replacement"]))
    tail = piece(F.element_at("es", n)["end"], F.octet_length("text").cast("bigint"))
    return d.select("doc_id", "path", F.when(n > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("text")).alias("text"))


def hunks(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, first_line, last_line, n_edits, rules): edits that touch the same lines together."""
    d = docs.select("doc_id", _bytes("text").alias("__b"))
    line = lambda at: F.length(F.regexp_replace(F.decode(F.substring(F.col("__b"), F.lit(1), at.cast("int")), "UTF-8"), "[^\n]", "")) + 1
    e = edits.join(d, "doc_id").withColumn("a", line(F.col("start"))).withColumn("b", line(F.col("end"))).drop("__b")
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    new = (F.col("a") > F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast("int")
    e = e.withColumn("__new", new).withColumn("hunk", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("doc_id", "hunk").agg(F.min("a").alias("first_line"), F.max("b").alias("last_line"), F.count("*").alias("n_edits"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules")).drop("hunk")


def as_stream(edits: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n, json): a header with the document's size, then an object an edit; a document without edits writes nothing."""
    size = docs.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), "path")
    head = edits.select("doc_id").distinct().join(size, "doc_id").select("doc_id", F.lit(0).alias("n"), F.to_json(F.struct(F.lit("quillspan-edits-1").alias("schema"), F.col("path").alias("source"), "bytes")).alias("json"))
    fields = [c for c in ("start", "end", "replacement", "expect", "rule", "severity", "confidence", "explanation") if c in edits.columns]
    return head.unionByName(ordered(edits).select("doc_id", F.col("nth").alias("n"), F.to_json(F.struct(*fields)).alias("json")))
