"""All registered queries of the engine, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from quillspan.plans import q_lines, q_links, q_more, q_prose, q_rewrite, q_structure, q_surface

    return [q_lines, q_structure, q_links, q_prose, q_rewrite, q_surface, q_more]


def _entries() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for m in _modules():
        out |= m.entries()
    return out


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _entries().items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["c14_repository_check"](spark, sf_dir)
