"""The engine's functions for SQL of a session."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.spread import spread

RECORD = ("seq", "kind", "start", "end", "line", "end_line", "depth", "level", "text", "label", "destination")


def register(spark: SparkSession) -> None:
    """md_records(text) gives the records of a text as a table; md_slug, md_fix and md_sentences are scalar. They run in the tasks of the table they are asked of: `view` gives one with enough."""
    from quillspan.operators import blocks, prose, rewrite

    class Records:
        def eval(self, text: str):
            for r in blocks.parse(text) if text is not None else ():
                yield tuple(r.get(n) for n in RECORD)

    kinds = ", ".join(f"`{n}` {blocks.COLUMNS[n]}" for n in RECORD)
    spark.udtf.register("md_records", F.udtf(Records, returnType=kinds))

    @F.arrow_udf("string")
    def slug(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else slug_text(x) for x in t.to_pylist()], pa.string())

    @F.arrow_udf("string")
    def fix(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else rewrite.rewrite(x)[0] for x in t.to_pylist()], pa.string())

    @F.arrow_udf("array<string>")
    def sentences(t: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [x[a:b] for a, b in prose.sentence_spans(x)] for x in t.to_pylist()], pa.list_(pa.string()))

    for name, f in (("md_slug", slug), ("md_fix", fix), ("md_sentences", sentences)):
        spark.udf.register(name, f)


def view(docs: DataFrame, name: str) -> None:
    """A view for these functions, whose rows lie in as many tasks as the cluster can use."""
    spread(docs).createOrReplaceTempView(name)


def slug_text(text: str) -> str:
    """`structure.slug` of a single text."""
    for a, b in (("---", "—"), ("--", "–"), ("...", "…")):
        text = text.replace(a, b)
    text = re.sub(r"\s+", " ", text)
    first = next((i for i, c in enumerate(text) if c.isalpha()), len(text))
    kept = "".join(c for c in text[first:] if c.isalnum() or c in "_-. ")
    return re.sub("-+", "-", kept.replace(" ", "-")).lower().strip("-") or "section"
