"""Exact k nearest neighbours by a pivot table.

The queries are every row whose id is divisible by EVERY, searched against all
rows. Distances of all vectors to PIVOTS pivots are computed once. By the triangle
inequality, |d(q, p) - d(x, p)| is a lower bound of d(q, x) for each pivot p, and
the greatest of them is the table's bound. Vectors are grouped by their nearest
pivot into blocks. The k-th distance inside its own block is a first limit for a
query; a query goes only to blocks whose range of pivot distances doesn't exclude
it. There candidates are evaluated by rising bound, STEP at a time, and each step
lowers the limit to the k-th distance so far; the search ends at the first bound
over the limit. Only distances of evaluated candidates are computed, and the
result is exact whatever the pivots are.

Distance is Euclidean, in double precision; ties go to the smaller id.

Defined results: null ids, null vectors, vectors with a null or not finite entry
and vectors of another length than the commonest (the longer, of equals) have no
neighbours and are none; rows that repeat an id count once, with the least
vector; fewer than k others give fewer rows; an empty table gives no rows; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.common import cut, read

K = 10
#: Ids divisible by this are queries.
EVERY = 50
PIVOTS = 32
#: Rows that pivots are chosen from, by a hash of their ids; this changes speed alone.
PIVOT_ROWS = 1024
BLOCK = 2048
#: Blocks whose ranges travel together.
BUNDLE = 8192
#: Candidates of each query that are evaluated at once, and queries side by side.
STEP, SIDE = 32, 128
#: Bounds are kept in single precision: a least slack, and one for each unit of the greatest pivot distance.
SLACK, ROUNDING = 1e-5, 4 * float(np.finfo(np.float32).eps)


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """Rows that are far from each other."""
    at = [0]
    d = np.linalg.norm(x - x[0], axis=1)
    while len(at) < min(n, len(x)):
        at.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(x - x[at[-1]], axis=1))
    return x[at]


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that count, and their length."""
    v = F.col(vec_col).cast("array<float>")
    fine = F.expr("v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = float('inf'))")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL").where(fine)
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = dim.d if dim else 0
    return rows.where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v")), dim


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)


def _kth(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """For the rows at these places, an upper limit of the distance of their k-th nearest other row here."""
    n = len(x)
    if n <= k:
        return np.full(len(at), np.inf)
    x = x.astype(np.float64)
    sq = (x * x).sum(axis=1)
    out = np.empty(len(at))
    for a in range(0, len(at), 512):
        q = at[a : a + 512]
        d = sq[q, None] + sq - 2 * (x[q] @ x.T)
        d[np.arange(len(q)), q] = np.inf
        out[a : a + 512] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return np.sqrt(np.maximum(out, 0)) * (1 + 1e-6) + 1e-6 * np.sqrt(sq.max() + 1e-30)


def search_block(q_id, q, q_pd, tau, x_id, x, x_pd, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, neighbour id, distance): for each query the best k of these rows, ties included, that its limit allows; and how many distances that took."""
    x64, q64 = x.astype(np.float64), q.astype(np.float64)
    xt, out, evaluated = np.ascontiguousarray(x_pd.T), [], 0
    slack = SLACK + ROUNDING * max(float(q_pd.max(initial=0)), float(x_pd.max(initial=0)))
    for a in range(0, len(q), SIDE):
        v, limit, me = q64[a : a + SIDE], tau[a : a + SIDE].copy(), q_id[a : a + SIDE]
        bound, gap = np.zeros((len(v), len(x)), np.float32), np.empty((len(v), len(x)), np.float32)
        for p in range(len(xt)):
            np.subtract(q_pd[a : a + SIDE, p, None], xt[p], out=gap)
            np.abs(gap, out=gap)
            np.maximum(bound, gap, out=bound)
        bound[x_id == me[:, None]] = np.inf
        order = np.argsort(bound, axis=1)
        best = np.full((len(v), k), np.inf)
        rows = np.arange(len(v))
        for s in range(0, len(x), STEP):
            at = order[rows, s : s + STEP]
            low = bound[rows[:, None], at]
            go = (low <= (limit[rows] + slack)[:, None]) & np.isfinite(low)
            rows, at, go = rows[go[:, 0]], at[go[:, 0]], go[go[:, 0]]  # the bounds rise, so a query whose next one is over its limit is done
            if not len(rows):
                break
            i, j = np.nonzero(go)
            d = np.full(go.shape, np.inf)
            d[i, j] = np.sqrt(((x64[at[i, j]] - v[rows[i]]) ** 2).sum(axis=1))
            evaluated += len(i)
            near = (d <= limit[rows][:, None]) & np.isfinite(d)
            i, j = np.nonzero(near)
            out.append((me[rows[i]], x_id[at[i, j]], d[i, j], rows[i] + a))
            best[rows] = np.sort(np.concatenate([best[rows], d], axis=1), axis=1)[:, :k]
            limit[rows] = np.minimum(limit[rows], best[rows, k - 1])
        tau[a : a + SIDE] = limit
    cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, float, np.int64))]
    fine = cols[2] <= tau[cols[3]]
    return cols[0][fine], cols[1][fine], cols[2][fine], evaluated


BLOCKS = "block long, ids binary, vecs binary, pds binary, asks binary, tau binary, lo array<float>, hi array<float>"
QUERIES = "block long, ids binary, vecs binary, pds binary, tau binary"


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, rank, neighbor_id, distance) of the k nearest others of every vector whose id is divisible by every."""
    empty = "vec_id long, rank int, neighbor_id long, distance double"
    if k < 1 or every < 1:
        raise ValueError("k and every must be at least 1")
    rows, dim = valid(vectors, id_col, vec_col)
    if not dim:
        return vectors.sparkSession.createDataFrame([], empty)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_ROWS).collect()
    pivots = farthest_first(np.array([r.v for r in some], np.float64), PIVOTS)
    width = len(pivots)

    def place(batches):
        for b in batches:
            x = _matrix(b["v"], dim)
            pd = np.sqrt(np.maximum(((x.astype(np.float64)[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0)) if len(x) < 2000 else np.concatenate([np.sqrt(((c.astype(np.float64)[:, None, :] - pivots[None]) ** 2).sum(axis=2)) for c in np.array_split(x, -(-len(x) // 1000))])
            flat = pa.array(pd.astype(np.float32).reshape(-1))
            pds = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], pds, pa.array(pd.argmin(axis=1).astype(np.int32))], names=["id", "v", "pd", "cell"])

    placed = cut(rows.mapInArrow(place, "id long, v array<float>, pd array<float>, cell int"))
    parts = {r.cell: -(-r["count"] // BLOCK) for r in placed.groupBy("cell").count().collect()}  # one row a pivot
    split = F.create_map(*[F.lit(z) for c, n in parts.items() for z in (c, n)])
    placed = placed.withColumn("block", F.col("cell").cast("long") * (1 << 40) + F.pmod(F.xxhash64("id"), split[F.col("cell")].cast("long")))

    def gather(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        ids = t["id"].to_numpy()[order]
        x, pd = _matrix(t["v"], dim)[order], _matrix(t["pd"], width)[order]
        q = np.flatnonzero(ids % every == 0)
        cols = [key[0].as_py(), ids.tobytes(), x.tobytes(), pd.tobytes(), q.tobytes(), _kth(x, q, k).tobytes(), pd.min(axis=0).tolist(), pd.max(axis=0).tolist()]
        types = (pa.int64(), *[pa.binary()] * 5, pa.list_(pa.float32()), pa.list_(pa.float32()))
        return pa.table([pa.array([c], ty) for c, ty in zip(cols, types)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    blocks = cut(placed.groupBy("block").applyInArrow(gather, BLOCKS))
    bundles = max(1, -(-sum(parts.values()) // BUNDLE))
    ranges = blocks.select(F.pmod(F.xxhash64("block"), F.lit(bundles)).cast("int").alias("bundle"), F.struct("block", "lo", "hi").alias("r"))
    ranges = ranges.groupBy("bundle").agg(F.collect_list("r").alias("targets"))

    def route(batches):
        for b in batches:
            for i, v, d, q, t, targets in zip(*(b[c].to_pylist() for c in ("ids", "vecs", "pds", "asks", "tau", "targets"))):
                q, tau = np.frombuffer(q, np.int64), np.frombuffer(t, np.float64)
                ids, x, pd = np.frombuffer(i, np.int64)[q], np.frombuffer(v, np.float32).reshape(-1, dim)[q], np.frombuffer(d, np.float32).reshape(-1, width)[q]
                for r in sorted(targets, key=lambda r: r["block"]):
                    lo, hi = np.array(r["lo"], np.float32), np.array(r["hi"], np.float32)
                    slack = SLACK + ROUNDING * max(float(pd.max(initial=0)), float(hi.max()))
                    go = np.maximum(lo - pd, pd - hi).max(axis=1) <= tau + slack
                    if go.any():
                        cols = (r["block"], ids[go].tobytes(), x[go].tobytes(), pd[go].tobytes(), tau[go].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([c], ty) for c, ty in zip(cols, (pa.int64(), *[pa.binary()] * 4))], names=[c.split()[0] for c in QUERIES.split(", ")])

    # queries go to every bundle of ranges, by an equal join
    asking = blocks.where(F.length("asks") > 0).select("ids", "vecs", "pds", "asks", "tau", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"))
    asked = asking.join(ranges, "bundle").repartition(max(1, sum(parts.values())), F.col("ids")).mapInArrow(route, QUERIES)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for c in zip(*(left[n].to_pylist() for n in ("ids", "vecs", "pds"))):
            x_id, x, x_pd = (np.frombuffer(y, ty).reshape(-1, *s) for y, ty, s in zip(c, (np.int64, np.float32, np.float32), ((), (dim,), (width,))))
            for q in zip(*(right[n] for n in ("ids", "vecs", "pds", "tau"))):
                q_id, qv, q_pd, tau = (np.frombuffer(y.as_py(), ty).copy().reshape(-1, *s) for y, ty, s in zip(q, (np.int64, np.float32, np.float32, np.float64), ((), (dim,), (width,), ())))
                found.append(search_block(q_id, qv, q_pd, tau, x_id, x, x_pd, k)[:3])
        cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, ty) for j, ty in enumerate((np.int64, np.int64, float))]
        return pa.table([pa.array(c) for c in cols], names=["q", "x", "d"])

    hits = blocks.select("block", "ids", "vecs", "pds").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(answer, "q long, x long, d double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "x"))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("vec_id"), "rank", F.col("x").alias("neighbor_id"), F.round("d", 5).alias("distance"))


def query(spark, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))


SQL = f"""
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round(d, 5) AS distance FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0)
WHERE rank <= {K}
"""
