"""Queries of sinks and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.operators import blocks as B
from quillspan.operators import checks as C
from quillspan.plans import recipes as R
from quillspan.sources import readers, sinks


def _findings(spark, d):
    rec = B.records(R.skips(spark, d))
    docs = R.fences(spark, d)
    return C.heading_skips(rec).unionByName(C.unterminated_fences(B.records(docs)))


def _gate(spark, d):
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, F.unhex(F.lit("61C3"))).when(k % 4 == 1, F.unhex(F.lit("61EDA080"))).when(k % 4 == 2, F.unhex(F.lit("610062"))).otherwise(F.encode("s_name", "UTF-8"))
    return readers.gate_encoding(R.table(spark, d, "supplier").select(k.cast("bigint").alias("doc_id"), F.col("s_name").alias("path"), raw.alias("content")))


def entries():
    out = {}
    out["s15_sarif_results"] = (lambda spark, d: sinks.sarif_results(_findings(spark, d)).select("path", "rule_index", "level", "start_line"), "SELECT 'nation-' || n_nationkey || '.md' AS path, 0 AS rule_index, 'warning' AS level, 3 AS start_line FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT 'customer-' || c_custkey || '.md', 1, 'error', 3 FROM customer WHERE c_custkey % 3 = 0")
    out["s14_text"] = (lambda spark, d: sinks.as_text(C.heading_skips(B.records(R.skips(spark, d)))), "SELECT 'nation-' || n_nationkey || '.md:3: warning: level 3 after level 1 [check.heading-skip]' AS value FROM nation WHERE n_nationkey % 4 = 0")
    out["s05_refused"] = (lambda spark, d: _gate(spark, d)[1].select("doc_id", "offset", "reason"), "SELECT s_suppkey AS doc_id, 1 AS offset, CASE s_suppkey % 4 WHEN 0 THEN 'truncated' WHEN 1 THEN 'surrogate' ELSE 'nul' END AS reason FROM supplier WHERE s_suppkey % 4 < 3")
    out["s04_accepted"] = (lambda spark, d: _gate(spark, d)[0].select("doc_id", "text"), "SELECT s_suppkey AS doc_id, s_name AS text FROM supplier WHERE s_suppkey % 4 = 3")
    return out
