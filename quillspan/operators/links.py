"""The link graph of a set of documents: built from records, checked by joins, repaired by edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import patterns as P
from quillspan.operators.structure import headings

FINDING = ("doc_id", "path", "rule", "severity", "line", "start", "end", "message")


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def sorted_(df: DataFrame) -> DataFrame:
    """The side of a join that grows with the documents: their estimated size is that of the file their keys are in, by which the optimizer would broadcast them."""
    return df.hint("merge")


def finding(df: DataFrame, rule: str | Column, severity: str | Column, message: Column, *extra: str) -> DataFrame:
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("doc_id", "path", col(rule).alias("rule"), col(severity).alias("severity"), F.col("line").cast("int").alias("line"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), message.alias("message"), *extra)


def label_key(label: str | Column) -> Column:
    c = F.col(label) if isinstance(label, str) else label
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def bare(destination: Column) -> Column:
    """A destination without angle brackets, title or escapes."""
    d = F.trim(destination)
    angle = F.regexp_extract(d, "^<([^>]*)>", 1)
    return F.when(d.startswith("<") & (angle != ""), angle).otherwise(F.regexp_replace(F.regexp_extract(d, r"^((?:\\.|[^ \t\\])*)", 1), r"\\(.)", "$1"))


def external(target: Column) -> Column:
    return target.rlike(P.EXTERNAL)


def split_target(destination: Column) -> tuple[Column, Column]:
    """(path, anchor); the anchor's percent escapes are decoded, malformed ones stay."""
    at = F.instr(destination, "#")
    raw = F.when(at > 0, F.substring(destination, at + 1, F.length(destination))).otherwise("")
    anchor = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.when(at > 0, F.substring(destination, F.lit(1), at - 1)).otherwise(destination), anchor


def resolve(base: Column, target: Column) -> Column:
    """target as seen from the directory of base; leading .. beyond the root are dropped."""
    directory = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.when(target.startswith("/"), target).otherwise(F.concat(directory, target)), "/")
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "") | (x == "."), acc).when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(stack, "/")


class Graph:
    """Anchors, links, definitions and notes of every document."""

    def __init__(self, records: DataFrame):
        self.anchors = headings(records).select("doc_id", "path", "slug", F.col("plain").alias("text"))
        self.links = records.where("kind IN ('link', 'image')").select("doc_id", "path", "kind", "line", "start", "end", "form", "label", "text", "destination", "dest_start", "dest_end")
        first = lambda key: Window.partitionBy("doc_id", key).orderBy("start")
        defs = records.where("kind = 'reference_def'").withColumn("key", label_key("label")).withColumn("nth", F.row_number().over(first("key")))
        self.all_definitions = defs.select("doc_id", "path", "key", "label", "line", "start", "end", "destination", "dest_start", "dest_end", "nth")
        self.definitions = self.all_definitions.where("nth = 1")
        notes = records.where("kind = 'footnote_def'").withColumn("nth", F.row_number().over(first("label")))
        self.notes = notes.where("nth = 1").select("doc_id", "path", "label", "line", "start", "end")
        bodies = records.where("kind = 'footnote_def'").select("doc_id", F.col("start").alias("parent"), F.lit(True).alias("in_body"))
        refs = records.where("kind = 'footnote_ref'").select("doc_id", "path", "label", "line", "start", "end", "parent")
        self.note_refs = refs.join(sorted_(bodies), ["doc_id", "parent"], "left").withColumn("in_body", F.coalesce("in_body", F.lit(False)))
        key = F.when((F.col("form") == "reference") & (F.coalesce("label", F.lit("")) == ""), F.col("text")).otherwise(F.col("label"))
        self.named = self.links.where("form IN ('reference', 'shortcut')").withColumn("shown", key).withColumn("key", label_key("shown"))

    def destinations(self) -> DataFrame:
        """Local destinations of all links, those of reference links by way of their definitions."""
        own = self.links.where("form = 'inline'").withColumn("to", bare(F.col("destination")))
        d = self.definitions.select("doc_id", "key", F.col("destination").alias("d"), F.col("dest_start").alias("d0"), F.col("dest_end").alias("d1"))
        via = self.named.join(sorted_(d), ["doc_id", "key"]).withColumn("to", bare(F.col("d"))).drop("dest_start", "dest_end").withColumnsRenamed({"d0": "dest_start", "d1": "dest_end"})
        cols = ["doc_id", "path", "kind", "line", "start", "end", "to", "dest_start", "dest_end"]
        out = own.select(*cols).unionByName(via.select(*cols)).where((F.col("to") != "") & ~external(F.col("to")))
        target, anchor = split_target(F.col("to"))
        return out.withColumn("target", target).withColumn("anchor", anchor).withColumn("resolved", F.when(F.col("target") != "", resolve(F.col("path"), F.col("target"))))

    # rules
    def broken_here(self) -> DataFrame:
        d = self.destinations().where("target = '' AND anchor <> ''")
        return finding(d.join(sorted_(self.anchors.select("doc_id", F.col("slug").alias("anchor"))), ["doc_id", "anchor"], "left_anti"), "links.broken-anchor", "error", F.concat(F.lit("no heading for #"), "anchor"), "dest_start", "dest_end", "to")

    def missing_files(self, files: DataFrame) -> DataFrame:
        d = self.destinations().where("target <> ''")
        return finding(d.join(sorted_(files.select(F.col("path").alias("resolved")).distinct()), "resolved", "left_anti"), "links.missing-file", "error", F.concat(F.lit("no file "), "target"), "dest_start", "dest_end", "to")

    def broken_elsewhere(self, files: DataFrame, scope: DataFrame) -> DataFrame:
        """Anchors of other documents of this run; a document outside of it isn't judged."""
        d = self.destinations().where("target <> '' AND anchor <> ''").join(sorted_(files.select(F.col("path").alias("resolved")).distinct()), "resolved", "left_semi")
        d = d.join(sorted_(scope.select(F.col("path").alias("resolved")).distinct()), "resolved", "left_semi")
        have = self.anchors.select(F.col("path").alias("resolved"), F.col("slug").alias("anchor"))
        return finding(d.join(sorted_(have), ["resolved", "anchor"], "left_anti"), "links.broken-anchor", "error", F.concat("target", F.lit(" lacks #"), "anchor"), "dest_start", "dest_end", "to")

    def undefined_references(self) -> DataFrame:
        lost = self.named.join(sorted_(self.definitions.select("doc_id", "key")), ["doc_id", "key"], "left_anti")
        some = self.definitions.select("doc_id").distinct().withColumn("some", F.lit(True))
        lost = lost.join(sorted_(some), "doc_id", "left").where((F.col("form") != "shortcut") | F.col("some"))
        return finding(lost, "links.undefined-reference", F.when(F.col("form") == "shortcut", "warning").otherwise("error"), F.concat(F.lit("undefined ["), "shown", F.lit("]")))

    def unused_definitions(self) -> DataFrame:
        d = self.definitions.join(sorted_(self.named.select("doc_id", "key").distinct()), ["doc_id", "key"], "left_anti")
        return finding(d.withColumn("start", F.lit(0)).withColumn("end", F.lit(0)), "links.unused-definition", "warning", F.concat(F.lit("["), "key", F.lit("] is never used")))

    def undefined_notes(self) -> DataFrame:
        return finding(self.note_refs.join(sorted_(self.notes.select("doc_id", "label")), ["doc_id", "label"], "left_anti"), "links.undefined-footnote", "error", F.concat(F.lit("undefined note "), "label"))

    def reused_notes(self) -> DataFrame:
        w = Window.partitionBy("doc_id", "label").orderBy("start")
        r = self.note_refs.where("NOT in_body").join(sorted_(self.notes.select("doc_id", "label")), ["doc_id", "label"], "left_semi")
        r = r.withColumn("nth", F.row_number().over(w)).withColumn("first", F.first("line").over(w)).where("nth > 1")
        return finding(r, "links.reused-footnote", "error", F.concat(F.lit("note "), "label", F.lit(" was first used on line "), F.col("first").cast("string")))

    def unused_notes(self) -> DataFrame:
        d = self.notes.join(sorted_(self.note_refs.select("doc_id", "label").distinct()), ["doc_id", "label"], "left_anti")
        return finding(d.withColumn("start", F.lit(0)).withColumn("end", F.lit(0)), "links.unused-footnote", "warning", F.concat(F.lit("note "), "label", F.lit(" is never used")))

    def findings(self, files: DataFrame, scope: DataFrame | None = None) -> DataFrame:
        """All of these rules; order by path, line and start to print."""
        scope = files if scope is None else scope
        plain = [self.undefined_references(), self.unused_definitions(), self.undefined_notes(), self.reused_notes(), self.unused_notes()]
        spans = [self.broken_here(), self.missing_files(files), self.broken_elsewhere(files, scope)]
        return union([p.select(*FINDING) for p in [*plain, *spans]])

    def export(self) -> DataFrame:
        """(doc_id, part, json): anchors, links, definitions and notes as JSON lines."""
        parts = [("anchor", self.anchors), ("link", self.links), ("definition", self.definitions), ("footnote", self.notes), ("footnote_ref", self.note_refs)]
        return union([df.select("doc_id", F.lit(n).alias("part"), F.to_json(F.struct(*[c for c in df.columns if c not in ("doc_id", "path")])).alias("json")) for n, df in parts])


# repairs


def nearest(wanted: Column, have: Column) -> tuple[Column, Column]:
    """(distance or -1 beyond the limit, limit): an edit for each four letters, at least one."""
    cap = F.greatest(F.lit(1), F.floor(F.length(wanted) / 4).cast("int"))
    return F.when(F.levenshtein(wanted, have) <= cap, F.levenshtein(wanted, have)).otherwise(-1), cap


def anchor_candidates(broken: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates of the best tier that has any: same slug, same but for case, nearest."""
    from quillspan.operators.structure import slug

    b = broken.withColumn("wanted", F.expr("substring(to, instr(to, '#') + 1)"))
    c = b.join(anchors.select("doc_id", F.col("slug").alias("have")).distinct(), "doc_id")
    dist, _ = nearest(F.col("wanted"), F.col("have"))
    c = c.withColumn("distance", dist)
    tier = F.when(slug("wanted") == F.col("have"), 1).when(F.lower("wanted") == F.lower("have"), 2).when(F.col("distance") >= 0, 3)
    c = c.withColumn("tier", tier).where("tier IS NOT NULL")
    w = Window.partitionBy("doc_id", "start")
    c = c.withColumn("rank", F.dense_rank().over(w.orderBy("tier", F.when(F.col("tier") == 3, F.col("distance")).otherwise(0)))).where("rank = 1")
    return c.withColumn("n", F.count("*").over(w)).withColumn("confidence", F.when(F.col("tier") < 3, "high").otherwise("medium"))


def moved_files(missing: DataFrame, files: DataFrame) -> DataFrame:
    """Files of the same name elsewhere, as seen from the document, the fragment kept."""
    target, _ = split_target(F.col("to"))
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    m = missing.withColumn("base", name(target)).join(files.select(F.col("path").alias("have"), name(F.col("path")).alias("base")).distinct(), "base").where("have <> path")
    up = F.size(F.split("path", "/")) - 1
    fragment = F.regexp_extract("to", "(#.*)$", 1)
    m = m.withColumn("replacement", F.concat(F.repeat(F.lit("../"), up), "have", fragment))
    return m.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "start")))


def repair_edits(candidates: DataFrame, replacement: Column) -> DataFrame:
    """Edits of findings with exactly one candidate that can be written bare."""
    e = candidates.where("n = 1 AND dest_start IS NOT NULL").withColumn("replacement", replacement).where(~F.col("replacement").rlike(r"[\s()<>\\]"))
    return e.select("doc_id", F.col("dest_start").alias("start"), F.col("dest_end").alias("end"), "replacement", "rule", "severity", F.coalesce(F.col("confidence") if "confidence" in e.columns else F.lit(None), F.lit("high")).alias("confidence"), F.col("to").alias("expect"))


def safe_edits(edits: DataFrame) -> DataFrame:
    """Edits without repeats, and without any whole cluster of overlapping ones."""
    e = edits.dropDuplicates(["doc_id", "start", "end", "replacement"]).withColumn("__n", F.monotonically_increasing_id())
    w = Window.partitionBy("doc_id").orderBy("start", "end", "__n")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("__new", (F.col("start") >= F.coalesce(reach, F.lit(-1))).cast("int")).withColumn("__cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count("*").over(Window.partitionBy("doc_id", "__cluster"))
    return e.withColumn("__size", size).where("__size = 1").drop("__n", "__new", "__cluster", "__size")
