"""Exact dedup by a tree merge of sorted digest runs.

Every shard of the input becomes runs of (MD5, SHA-256, length, id), sorted by
digest. In each round FAN neighbouring runs exchange slices of their digest
range and are merged: equal digests are verified by SHA-256 and length and the
smallest id is retained, the others are written down with the id that beat them.
After log_FAN(shards) rounds each shard holds one digest range, merged over the
whole table, so no step gathers more than its share, and copies in hot groups
already vanish in the first rounds.

Defined results: a null text is never a copy; an empty text is a text like any
other; rows that repeat an id are the same document and share its fate; a row
without id is kept. A very long text is digested whole; of equal ids either row
stands for both; an empty table gives no rows. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut, plan_bytes, small

FAN = 4
WIDTH = 56  # MD5 16, SHA-256 32, length 8
#: Estimated input bytes for each run of the first round.
RUN_BYTES = 32 << 20
OUT = "block int, range long, run binary, ids binary, lost binary, won binary"


def _merge(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with their smallest ids, and (lost, won) for each other id."""
    words = np.ascontiguousarray(key).view(">u8").reshape(-1, WIDTH // 8)
    order = np.lexsort((ids, *(words[:, c] for c in range(WIDTH // 8 - 1, -1, -1))))
    key, ids, words = key[order], ids[order], words[order]
    new = np.ones(len(key), bool)
    new[1:] = (words[1:] != words[:-1]).any(axis=1)  # the whole of the verifier, not the digest alone
    group = np.cumsum(new) - 1
    best = ids[new]
    lost = ~new & (ids != best[group] if len(best) else False)
    return key[new], best, ids[lost], best[group][lost] if len(best) else ids[lost]


def _rows(block: int, digit_shift: int, key, ids, lost, won) -> pa.RecordBatch:
    """One row for each digit of the digest range that the next round splits by."""
    top = np.ascontiguousarray(key[:, :8]).view(">u8").reshape(-1).astype(np.uint64) if len(key) else np.zeros(0, np.uint64)
    digit = (top >> np.uint64(64 - digit_shift)).astype(np.int64) if digit_shift else np.zeros(len(top), np.int64)
    cols: dict[str, list] = {n: [] for n in ("block", "range", "run", "ids", "lost", "won")}
    values, starts = np.unique(digit, return_index=True)  # digests are sorted, so digits are
    ends = np.append(starts[1:], len(digit))
    for v, a, b in zip(values.tolist(), starts.tolist(), ends.tolist()):
        for n, x in zip(cols, (block, v, key[a:b].tobytes(), ids[a:b].tobytes(), b"", b"")):
            cols[n].append(x)
    if len(lost):
        for n, x in zip(cols, (-1, -1, b"", b"", lost.tobytes(), won.tobytes())):
            cols[n].append(x)
    types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), types)], names=list(cols))


def _digits(round_no: int, bits: int) -> int:
    return (round_no + 1) * bits


def _merger(shift: int):
    def merge(t: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(t["run"].to_pylist()), np.uint8).reshape(-1, WIDTH)
        ids = np.frombuffer(b"".join(t["ids"].to_pylist()), np.int64)
        return pa.Table.from_batches([_rows(t["block"][0].as_py() // FAN, shift, *_merge(key, ids))])

    return merge


def losers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) of every document that is a copy of one with a smaller id."""
    spark = docs.sparkSession
    bits = FAN.bit_length() - 1
    rounds, n = 0, 1
    while n < -(-plan_bytes(docs) // RUN_BYTES):
        n, rounds = n * FAN, rounds + 1
    text, ident = F.col(text_col), F.col(id_col).cast("long")
    data = text.cast("binary")
    entries = docs.where(text.isNotNull() & ident.isNotNull()).select(
        ident.alias("id"), F.concat(F.unhex(F.md5(data)), F.unhex(F.sha2(data, 256)), F.unhex(F.lpad(F.hex(F.octet_length(data).cast("long")), 16, "0"))).alias("key")
    )

    def first(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() % n if n > 1 else 0
        held, size = [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["id"].to_numpy().astype(np.int64)
            key = np.frombuffer(b"".join(t["key"].to_pylist()), np.uint8).reshape(-1, WIDTH)
            return _rows(block, _digits(0, bits) if rounds else 0, *_merge(key, ids))

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= 500_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    state = entries.mapInArrow(first, OUT)
    levels = []
    for r in range(max(rounds, 1)):
        state = cut(state)
        levels.append(state.where("block = -1").select("lost", "won"))

        state = state.where("block >= 0").withColumn("to", F.expr(f"block div {FAN}")).groupBy("to", "range").applyInArrow(_merger(_digits(min(r + 1, rounds - 1), bits) if rounds else 0), OUT)
    state = cut(state)
    levels.append(state.where("block = -1").select("lost", "won"))

    def pairs(batches):
        for b in batches:
            for lost, won in zip(b["lost"].to_pylist(), b["won"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(lost, np.int64)), pa.array(np.frombuffer(won, np.int64))], names=["doc_id", "keep_id"])

    out = None  # an id retained at one level may lose at a later one, so the later levels are resolved first
    for level in reversed(levels):
        here = level.mapInArrow(pairs, "doc_id long, keep_id long")
        if out is None:
            out = here
        else:
            later = out.select(F.col("doc_id").alias("keep_id"), F.col("keep_id").alias("final"))
            here = here.join(later, "keep_id", "left").select("doc_id", F.coalesce("final", "keep_id").alias("keep_id"))
            out = here.unionByName(out)
    return out.groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id) of every row: the smallest id among documents of exactly this text."""
    lost = small(cut(losers(docs, id_col, text_col)))
    return docs.select(F.col(id_col).cast("long").alias("doc_id")).join(lost, "doc_id", "left").select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents of which an exact copy with a smaller id exists."""
    lost = small(cut(losers(docs, id_col, text_col).select(F.col("doc_id").alias("__lost"))))
    return docs.join(lost, docs[id_col] == lost["__lost"], "left_anti")


SQL = """
SELECT doc_id, CASE WHEN text IS NULL OR doc_id IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id
FROM documents
"""
