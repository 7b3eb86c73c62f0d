"""Tables that several branches of a plan read, computed once and kept in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of strings, and 64 a row, up to which a counted table is broadcast.
BROADCAST_BYTES = 8 << 20


def kept(df: DataFrame) -> DataFrame:
    """df, written once; a lost executor loses none of it. A local folder is set only where the session names none, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), f"quillspan-{uuid.uuid4().hex[:8]}"))
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """df, kept, with a broadcast hint where it was counted to be small, else with one for a sorted join.

    Never left to the optimizer: rows that a file of few bytes expands to have as small an estimate as the file.
    """
    df = kept(df)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    size = df.agg(F.sum(sum(texts, F.lit(64)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")
