"""Rows laid over as many tasks as a cluster can use, before a pass that costs much more a row than reading it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

#: Tasks a core, so that uneven ones level out; bytes a task from which an input has tasks enough by its size.
TASKS_A_CORE, ENOUGH_BYTES = 3, 64 << 20


def cores(now: int, told: Callable[[str], str | None]) -> int:
    """Cores that a session will have: those registered now, or those its configuration asks for where they are more.

    A session plans its first query before its executors have registered, and then counts two cores at most.
    """
    number = lambda k: int(v) if (v := told(k) or "").isdigit() else 0
    local = re.match(r"local-cluster\[\s*(\d+)\s*,\s*(\d+)", told("spark.master") or "")
    executors = max(number("spark.executor.instances"), number("spark.dynamicAllocation.initialExecutors"), number("spark.dynamicAllocation.minExecutors"))
    return max(now, int(local[1]) * int(local[2]) if local else 0, number("spark.cores.max"), executors * max(number("spark.executor.cores"), 1))


def _laid(plan, most: int) -> bool:
    """Whether this logical plan only computes columns of, or filters, what was laid over as many partitions."""
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "Repartition" and plan.shuffle() and plan.numPartitions() >= most


def _rows_in(df: DataFrame, plan, most: int) -> bool:
    """Whether as many partitions of a plan's files can have rows: Parquet is split by bytes, but rows go to the split that has the middle of their row group."""
    leaves = plan.collectLeaves()
    if not all((x := leaves.apply(i)).nodeName() == "LogicalRelation" and str(x.relation()) == "parquet" for i in range(leaves.size())):
        return True
    files, groups = df.inputFiles(), 0
    if len(files) >= most:
        return True
    sc = df.sparkSession.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)), conf))
        groups += reader.getRowGroups().size()
        reader.close()
    return groups >= most


def spread(df: DataFrame) -> DataFrame:
    """df in at least TASKS_A_CORE partitions a core.

    Files are split by bytes, and a row group isn't split at all, so that a million short rows can lie
    in one partition, and the others of their file have none. Rows go round-robin, with one shuffle; an input that has
    partitions enough by its files and their row groups, or by its size where a shuffle precedes, stays as it is, and so does a stream. Keys that texts are built
    from are best spread themselves: the texts are then built in all tasks and not shuffled, nor spread again.
    """
    if df.isStreaming:
        return df
    sc = df.sparkSession.sparkContext
    most = TASKS_A_CORE * cores(sc.defaultParallelism, sc.getConf().get)
    done = df._jdf.queryExecution()
    if _laid(done.optimizedPlan(), most):
        return df
    if str(done.executedPlan().nodeName()).startswith("AdaptiveSparkPlan"):  # its partitions are known only when it has run
        enough = int(str(done.optimizedPlan().stats().sizeInBytes())) >= most * ENOUGH_BYTES
    else:
        enough = done.toRdd().getNumPartitions() >= most and _rows_in(df, done.optimizedPlan(), most)
    return df if enough else df.repartition(most)
