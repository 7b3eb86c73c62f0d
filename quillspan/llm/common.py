"""Shared helpers: Arrow text buffers, byte-level word spans, hashing, size-checked joins, shared storage."""

from __future__ import annotations

import ctypes
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the numpy kernels; one longer document is handled alone.
SLICE_BYTES = 1 << 20
#: Largest side, in estimated bytes, that is broadcast.
BROADCAST_BYTES = 8 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
BYTE_CODES = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: letters, digits and all of a multi-byte character.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_pow_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hashing base and of its inverse, modulo 2**64."""
    if "p" not in _pow_cache or len(_pow_cache["p"]) < n:
        size = max(n, SLICE_BYTES + 1)
        _pow_cache["p"], _pow_cache["i"] = _powers(_P, size), _powers(_P_INV, size)
    return _pow_cache["p"][:n], _pow_cache["i"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a copy; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    _, offs, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    if offs is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def slices(offsets: np.ndarray, most_rows: int = 4096, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about most_bytes of text each, at least one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most_bytes, side="right")) - 1
        b = min(max(b, a + 1), n, a + most_rows)
        yield a, b
        a = b


def word_spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of word bytes; no run crosses a row."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[raw]
    prev = np.zeros(n, bool)
    prev[1:] = w[:-1]
    first = offs[:-1]
    prev[first[first < n]] = False
    nxt = np.zeros(n, bool)
    nxt[:-1] = w[1:]
    last = offs[1:] - 1
    nxt[last[last >= 0]] = False
    start, end = np.flatnonzero(w & ~prev), np.flatnonzero(w & ~nxt) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def span_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial hash."""
    p, inv = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_CODES[low] * p[:-1], out=total[1:])
    return mix64((total[end] - total[start]) * inv[start])


def ngram_keys(raw: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words; a row of fewer words, but not none, has one key of all its words."""
    start, end, row = word_spans(raw, offs)
    if not len(start):
        return row, np.zeros(0, np.uint64)
    h = span_hashes(LOWER[raw], start, end)
    mult = np.uint64(0xD6E8FEB86659FD93)
    m = len(h) - n + 1
    rows, keys = [], []
    if m > 0:
        acc = h[:m].copy()
        for k in range(1, n):
            acc *= mult
            acc += h[k : k + m]
        same = row[:m] == row[n - 1 :]
        rows.append(row[:m][same])
        keys.append(acc[same])
    count = np.bincount(row, minlength=len(offs) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        at = np.searchsorted(row, short)
        acc = np.full(len(short), 0x1234567, np.uint64)
        for k in range(n - 1):
            has = k < count[short]
            acc[has] = acc[has] * mult + h[at[has] + k]
        rows.append(short)
        keys.append(acc ^ np.uint64(0x5555))
    return np.concatenate(rows), mix64(np.concatenate(keys))


def planes(a: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values, one byte position after the other, which compresses when they are sorted."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def packed(a: np.ndarray, width: int) -> bytes:
    """Values of so many bytes, as compressed differences; ascending ones take little room."""
    a = a.astype(np.uint64)
    a[1:] -= a[:-1].copy()
    blob = planes(a, width)
    return len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True)


def unpacked(blob, width: int) -> np.ndarray:
    blob = memoryview(blob)
    raw = pa.decompress(pa.py_buffer(blob[8:]), int.from_bytes(blob[:8], "little"), "zstd")
    return np.cumsum(unplanes(raw, width), dtype=np.uint64) & np.uint64((1 << 8 * width) - 1)


def spread(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes of the ranges that begin at lo and have the given sizes, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return out + np.arange(total)


_libc = None


def release() -> None:
    """Gives freed memory back to the system, so that a worker that waits for its next task holds little."""
    global _libc
    pa.default_memory_pool().release_unused()
    try:
        _libc = _libc or ctypes.CDLL("libc.so.6")
        _libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a DataFrame's size; where it has none, as for rows from the driver, the strings are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 56:
        return size
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t in ("string", "binary")]
    return df.agg(F.sum(sum(texts, F.lit(16)))).first()[0] or 0


def shards(df: DataFrame, each: int = 16 << 20, least: int = 4) -> int:
    """A power of two that puts about `each` estimated bytes of df in a shard."""
    return 1 << max(int(math.log2(least)), math.ceil(math.log2(max(1, plan_bytes(df) / each))))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage; a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), f"quillspan-{uuid.uuid4().hex[:8]}"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor loses none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, width: int = 16) -> DataFrame:
    """df (already cut) with a broadcast hint if its counted rows are few; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


#: Edges that one task links, 16 bytes each; beyond, they are linked over the table.
LINKED_AT_ONCE = 4_000_000


def linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of n nodes is linked with by edges (a, b), itself where there is none."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != (up := label[label])).any():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _link(t: pa.Table) -> pa.Table:
    a, b = t["a"].to_numpy(), t["b"].to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return pa.table([pa.array(nodes), pa.array(nodes[linked(at[: len(a)], at[len(a) :], len(nodes))])], names=["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b), already cut; root is the smallest node.

    Up to LINKED_AT_ONCE edges, counted, are linked in one task. More alternate two
    steps until nothing changes: neighbours take the least label around them, and
    labels jump to their label's label. Each round is cut.
    """
    if edges.count() <= LINKED_AT_ONCE:
        return cut(edges.select("a", "b").groupBy(F.lit(0).alias("all")).applyInArrow(_link, "node long, root long"))
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = both.unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct()
    label = cut(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("root")))
    both = cut(both)
    while True:
        near = both.join(label.select(F.col("x").alias("y"), F.col("root").alias("r")), "y").groupBy("x").agg(F.min("r").alias("r"))
        step = label.join(near, "x").select("x", F.least("root", "r").alias("root"), F.col("root").alias("old"))
        up = step.select(F.col("x").alias("root"), F.col("root").alias("up"))
        new = cut(step.join(up, "root", "left").select("x", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        changed = new.where(F.col("root") != F.col("old")).limit(1).count()
        label = new.select("x", "root")
        if not changed:
            return label.select(F.col("x").alias("node"), "root")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
