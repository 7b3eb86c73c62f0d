"""Sinks: findings as text lines, JSON lines and SARIF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_text(findings: DataFrame) -> DataFrame:
    return findings.select(F.format_string("%s:%d: %s: %s [%s]", "path", "line", "severity", "message", "rule").alias("value"))


def as_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(F.lit("finding").alias("kind"), "path", "rule", "severity", "line", "start", "end", "message")).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule, rule_index) in order of names."""
    rules = findings.agg(F.array_sort(F.collect_set("rule")).alias("rules"))  # as long as the catalogue
    return rules.select(F.posexplode("rules").alias("rule_index", "rule")).select("rule", "rule_index")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row a result: rule index, level and place; lines are at least 1."""
    f = findings.join(F.broadcast(sarif_rules(findings)), "rule")
    return f.select("path", "rule", "rule_index", F.when(F.col("severity") == "error", "error").otherwise("warning").alias("level"), F.greatest("line", F.lit(1)).alias("start_line"), "message")


def sarif(findings: DataFrame, tool: str = "quillspan") -> DataFrame:
    """(sarif): one SARIF 2.1.0 document, for a run's findings, which a reader opens whole."""
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias("physicalLocation")))
    res = sarif_results(findings).select(F.struct(F.col("path"), F.col("start_line"), F.struct(F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations")).alias("r")).alias("x"))
    res = res.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("results"))
    rules = sarif_rules(findings).agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_index", "rule"))), lambda x: F.struct(x["rule"].alias("id"))).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return res.crossJoin(rules).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
