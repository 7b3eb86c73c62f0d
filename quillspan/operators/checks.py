"""Repository checks: one finding table, with precedence and suppression as anti joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.kept import kept
from quillspan.operators.links import FINDING, Graph, bare, external, finding, label_key, resolve, sorted_, split_target, union
from quillspan.operators import rewrite
from quillspan.operators.structure import headings, slice_bytes


def heading_skips(records: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("start")
    h = records.where("kind = 'heading' AND depth = 0").withColumn("before", F.lag("level").over(w)).where("level > before + 1")
    return finding(h, "check.heading-skip", "warning", F.format_string("level %d after level %d", "level", "before"))


def image_alts(records: DataFrame) -> DataFrame:
    return finding(records.where("kind = 'image' AND trim(coalesce(text, '')) = ''"), "check.image-alt", "warning", F.lit("image without a text"))


def _assets(records: DataFrame) -> DataFrame:
    d = records.where("kind = 'image' AND form = 'inline'").withColumn("to", bare(F.col("destination"))).where((F.col("to") != "") & ~external(F.col("to")))
    return d.withColumn("target", split_target(F.col("to"))[0]).where("target <> ''")


def missing_assets(records: DataFrame, files: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """Images that are neither beside their document nor, as written or by name, under a root."""
    d = _assets(records).withColumn("resolved", resolve(F.col("path"), F.col("target")))
    have = files.select(F.col("path").alias("resolved")).distinct()
    d = d.join(sorted_(have), "resolved", "left_anti")
    for r in roots:
        for t in (F.col("target"), F.element_at(F.split("target", "/"), -1)):
            d = d.withColumn("resolved", resolve(F.lit(r.rstrip("/") + "/"), t)).join(sorted_(have), "resolved", "left_anti")
    return finding(d, "check.missing-asset", "error", F.concat(F.lit("no asset "), "target"))


def found_assets(records: DataFrame, missing: DataFrame) -> DataFrame:
    """Spans of images whose file is there."""
    return _assets(records).select("path", "start", "end").join(sorted_(missing.select("path", "start", "end")), ["path", "start", "end"], "left_anti")


def fence_languages(records: DataFrame, docs: DataFrame) -> DataFrame:
    f = records.where("kind = 'code_fence'").drop("text").join(sorted_(docs.select("doc_id", F.col("text").alias("__t"))), "doc_id")
    first = F.split(slice_bytes("__t", F.col("start"), F.col("end")), "\n")[0]
    return finding(f.where(F.regexp_replace(first, "[`~ \t]", "") == ""), "check.fence-language", "warning", F.lit("fence without a language"))


def unterminated_fences(records: DataFrame, rule: str = "check.unterminated-fence", severity: str = "error") -> DataFrame:
    return finding(records.where("kind = 'code_fence' AND unterminated"), rule, severity, F.lit("fence without an end"))


def duplicate_definitions(graph: Graph) -> DataFrame:
    d = graph.all_definitions.withColumn("first", F.first("line").over(Window.partitionBy("doc_id", "key").orderBy("start"))).where("nth > 1")
    return finding(d, "check.duplicate-definition", "error", F.concat(F.lit("["), "label", F.lit("] is defined on line "), F.col("first").cast("string")))


def lossy_math(records: DataFrame, docs: DataFrame) -> DataFrame:
    p = records.where("kind = 'paragraph'").drop("text").join(sorted_(docs.select("doc_id", F.col("text").alias("__t"))), "doc_id").withColumn("body", slice_bytes("__t", F.col("start"), F.col("end")))
    rule = F.when(F.col("body").contains("$$"), "check.lossy-math").when(F.col("body").contains("\\begin{"), "check.lossy-latex")
    return finding(p.withColumn("r", rule).where("r IS NOT NULL"), F.col("r"), "warning", F.lit("display mathematics may not survive"))


def anchor_collisions(records: DataFrame) -> DataFrame:
    """Anchors at several places of the repository, reported once, at the first."""
    h = headings(records).groupBy("slug").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("path", "line", "doc_id", "start", "end"))).alias("at")).where("n > 1")
    rest = F.array_join(F.transform(F.slice("at", 2, F.size("at")), lambda x: F.concat(x["path"], F.lit(":"), x["line"].cast("string"))), ", ")
    first = F.col("at")[0]
    h = h.select(first["doc_id"].alias("doc_id"), first["path"].alias("path"), first["line"].alias("line"), first["start"].alias("start"), first["end"].alias("end"), "slug", rest.alias("rest"))
    return finding(h, "check.anchor-collision", "warning", F.concat(F.lit("#"), "slug", F.lit(" also at "), "rest"))


# front matter

_KEYS = "doc_id bigint, path string, key string, key_line int, yaml_type string, value string, valid boolean"


def front_matter(records: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, path, key, key_line, yaml_type, value, valid) of every top key; one row with a null key where the block isn't a mapping."""
    f = records.where("kind = 'frontmatter'").drop("text").join(sorted_(docs.select("doc_id", F.col("text").alias("__t"))), "doc_id").select("doc_id", "path", slice_bytes("__t", F.col("start"), F.col("end")).alias("body"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(d, p, *k) for d, p, body in zip(b.doc_id, b.path, b.body) for k in yaml_keys(body)]
            yield pd.DataFrame(out, columns=["doc_id", "path", "key", "key_line", "yaml_type", "value", "valid"])

    return f.mapInPandas(run, _KEYS)


def yaml_scalar(v: str) -> tuple[str, str]:
    """(type, text) of a YAML scalar as written on one line."""
    import re

    v = re.sub(r"\s+#.*$", "", v).strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
        return "string", v[1:-1]
    if v in ("", "~", "null"):
        return "null", ""
    if re.fullmatch(r"(true|false|yes|no|on|off)", v, re.I):
        return "bool", v.lower()
    if re.fullmatch(r"[-+]?(\d[\d_]*|\d*\.\d+|\d+\.\d*)([eE][-+]?\d+)?", v):
        return "number", v
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}([T ][\d:.]+(Z|[-+]\d{2}:?\d{2})?)?", v):
        return "date", v
    return ("list", v) if v.startswith("[") and v.endswith("]") else ("string", v)


def yaml_keys(body: str) -> list[tuple]:
    """(key, line, type, value, valid) of the top level of a front-matter block; values of further lines are lists or maps."""
    import re

    lines, out = body.split("\n")[1:-1], []
    for i, s in enumerate(lines):
        if not s.strip() or s.lstrip().startswith("#") or s[0] in " \t" or s.startswith("- "):
            continue
        m = re.match(r"([^:#]+?)\s*:(?:\s+(.*)|\s*)$", s)
        if not m:
            return [(None, i + 2, None, None, False)]
        kind, value = yaml_scalar(m[2] or "")
        if kind == "null":
            nxt = next((x for x in lines[i + 1 :] if x.strip()), "")
            kind = "list" if re.match(r"\s*- ", nxt) else "map" if nxt[:1] in " \t" and nxt else "null"
        out.append((m[1].strip("\"'"), i + 2, kind, value, True))
    return out


def schema_findings(keys: DataFrame, docs: DataFrame, schema: Sequence[dict], unknown: str | None = "warning") -> DataFrame:
    """Front matter against rows of field, type, required and one_of."""
    spark = docs.sparkSession
    rows = [(s["field"], s.get("type", "any"), bool(s.get("required")), s.get("one_of")) for s in schema]
    sch = F.broadcast(spark.createDataFrame(rows, "key string, type string, required boolean, one_of array<string>"))  # as long as the configuration
    at = lambda df, line: df.withColumn("line", line).withColumn("start", F.lit(0)).withColumn("end", F.lit(0))
    base = docs.select("doc_id", "path")
    have = keys.where("valid").select("doc_id", "key")
    blocks = keys.select("doc_id").distinct()
    need = [s["field"] for s in schema if s.get("required")]
    out = []
    if need:
        none = base.join(blocks, "doc_id", "left_anti")
        out.append(finding(at(none, F.lit(1)), "check.frontmatter-missing", "error", F.lit("no front matter; needs " + ", ".join(need))))
        lacks = base.join(keys.where("valid").select("doc_id").distinct(), "doc_id", "left_semi").crossJoin(sch.where("required").select("key")).join(have, ["doc_id", "key"], "left_anti")
        out.append(finding(at(lacks, F.lit(1)), "check.frontmatter-missing", "error", F.concat(F.lit("lacks "), "key")))
    typed = keys.where("valid").join(sch, "key")
    wrong = (F.col("type") != "any") & (F.col("type") != F.col("yaml_type"))
    out.append(finding(at(typed.where(wrong), F.col("key_line")), "check.frontmatter-type", "error", F.concat("key", F.lit(" is "), "yaml_type", F.lit(", not "), "type")))
    out.append(finding(at(typed.where(~wrong & F.col("one_of").isNotNull() & ~F.array_contains("one_of", F.col("value"))), F.col("key_line")), "check.frontmatter-value", "error", F.concat("key", F.lit(" can't be "), "value")))
    if unknown:
        out.append(finding(at(keys.where("valid").join(sch.select("key"), "key", "left_anti"), F.col("key_line")), "check.frontmatter-unknown", unknown, F.concat(F.lit("unknown key "), "key")))
    out.append(finding(at(keys.where("NOT valid"), F.col("key_line")), "check.frontmatter-invalid", "error", F.lit("front matter isn't a mapping")))
    return union(out)


# bibliography


def bib_keys(sources: DataFrame) -> DataFrame:
    """(source, key) of bibliography files (path, format, content): BibTeX entries or CSL JSON."""
    bib = sources.where("format = 'bibtex'").select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("content", F.lit(r"(?i)@(?!string\b|comment\b|preamble\b)[a-z]+\s*\{\s*([^,\s}]+)"), F.lit(1))).alias("key"))
    csl = sources.where("format = 'csl-json'").select(F.col("path").alias("source"), F.explode(F.from_json("content", "array<struct<id:string>>")).alias("e")).select("source", F.col("e.id").alias("key")).where("key IS NOT NULL")
    yml = sources.where("format = 'csl-yaml'").select(F.col("path").alias("source"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*-?\s*id:\s*[\"']?([^\"'\s]+)"), F.lit(1))).alias("key"))
    return bib.unionByName(csl).unionByName(yml).distinct()


def bib_errors(sources: DataFrame) -> DataFrame:
    """Sources that can't be read, which isn't the same as empty."""
    bad = F.col("content").isNull() | ((F.col("format") == "csl-json") & F.from_json("content", "array<struct<id:string>>").isNull()) | ~F.col("format").isin("bibtex", "csl-json", "csl-yaml")
    return sources.where(bad).select(F.col("path").alias("source"))


def unresolved_citations(records: DataFrame, named: DataFrame, keys: DataFrame, errors: DataFrame) -> DataFrame:
    """Citations without an entry. named: (doc_id, source). A document that names none isn't judged, nor one with a source that can't be read."""
    records = kept(records.select("doc_id", "path", "kind", "line", "start", "end", "key"))
    judged = named.select("doc_id").distinct().join(named.join(errors, "source").select("doc_id").distinct(), "doc_id", "left_anti")
    c = records.where("kind = 'citation'").join(sorted_(judged), "doc_id", "left_semi")
    # each citation asks the sources of its own document: documents that share a source aren't multiplied by its entries
    asked = c.select("doc_id", "key").distinct().join(sorted_(named), "doc_id")
    have = asked.join(sorted_(keys.select("source", "key")), ["source", "key"], "left_semi").select("doc_id", "key").distinct()
    lost = finding(c.join(sorted_(have), ["doc_id", "key"], "left_anti"), "check.unresolved-citation", "error", F.concat(F.lit("no entry for @"), "key"))
    docs = records.select("doc_id", "path").distinct()
    bad = named.join(errors, "source").join(docs, "doc_id").withColumn("line", F.lit(1)).withColumn("start", F.lit(0)).withColumn("end", F.lit(0))
    return lost.unionByName(finding(bad, "check.bibliography-unreadable", "error", F.concat(F.lit("can't read "), "source")))


# the whole


def suppressed(rule: Column, prefixes: Sequence[str]) -> Column:
    """Whether a rule is named by one of these, exactly or as a prefix with a star."""
    out = F.lit(False)
    for p in prefixes:
        out = out | (rule.startswith(p[:-1]) if p.endswith("*") else rule == p)
    return out


def precede(findings: DataFrame, found: DataFrame, suppress: Sequence[str] = ()) -> DataFrame:
    """Suppression, and of two findings of one defect the more telling."""
    keep = kept(findings.where(~suppressed(F.col("rule"), suppress)).select(*FINDING))  # read three times here, and each part of it is a pass over the documents
    asset = keep.where("rule = 'check.missing-asset'").select("path", "start", "end")
    hide = found.select("path", "start", "end").unionByName(asset).distinct().withColumn("rule", F.lit("links.missing-file"))
    open_ = keep.where("rule = 'check.unterminated-fence'").select("doc_id").distinct().withColumn("rule", F.lit("dialect.fence.unterminated"))
    return keep.join(sorted_(hide), ["path", "start", "end", "rule"], "left_anti").join(sorted_(open_), ["doc_id", "rule"], "left_anti").select(*FINDING)


#: What the rules below read of records.
CHECKED = ("heading", "paragraph", "code_fence", "image", "link", "reference_def", "footnote_def", "footnote_ref")
CHECKED_COLUMNS = ("doc_id", "path", "kind", "line", "start", "end", "depth", "parent", "level", "text", "plain", "form", "unterminated", "label", "destination", "dest_start", "dest_end")


def check(records: DataFrame, docs: DataFrame, files: DataFrame, roots: Sequence[str] = (), suppress: Sequence[str] = (), dialect: DataFrame | None = None) -> DataFrame:
    """All structural and link findings of a repository; `ordered` sorts them to print. The records are kept, so that all rules read one parse."""
    records = kept(records.where(F.col("kind").isin(*CHECKED)).select(*CHECKED_COLUMNS))
    g = Graph(records)
    missing = missing_assets(records, files, roots)
    parts = [heading_skips(records), image_alts(records), missing, fence_languages(records, docs), unterminated_fences(records), duplicate_definitions(g), lossy_math(records, docs), anchor_collisions(records), g.findings(files, docs.select("path"))]
    if dialect is not None:
        parts.append(dialect)
    return precede(union([p.select(*FINDING) for p in parts]), found_assets(records, missing), suppress)


def dialect(docs: DataFrame, rewritten: DataFrame | None = None) -> DataFrame:
    """Required repairs as errors, since the document isn't canonical with them open, and lints as warnings; rules begin with dialect."""
    paths = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "path")
    fix = rewrite.hits(rewrite.rewrite_documents(docs) if rewritten is None else rewritten).where(F.col("rule").isin(*rewrite.REQUIRED)).withColumn("severity", F.lit("error"))
    lint = rewrite.lint_documents(docs).withColumn("severity", F.lit("warning"))
    label = F.create_map(*[F.lit(x) for r in rewrite.RULES for x in (r, rewrite.LABELS[r])])[F.col("rule")]
    rows = fix.unionByName(lint).join(sorted_(paths), "doc_id").withColumn("start", F.lit(0)).withColumn("end", F.lit(0))
    message = F.when(F.col("severity") == "error", F.concat(F.lit("not canonical: "), label)).otherwise(label)
    return finding(rows, F.concat(F.lit("dialect."), "rule"), F.col("severity"), message)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings as they are printed: by path, line and rule."""
    return findings.orderBy("path", "line", "rule", "start", "message")


def exit_code(findings: DataFrame | None, warnings: bool = False) -> int:
    """0 clean, 1 with errors, or with warnings where these count, 2 where the run itself failed and there are none."""
    if findings is None:
        return 2
    return int(findings.where("severity = 'error'" if not warnings else "true").limit(1).count() > 0)
