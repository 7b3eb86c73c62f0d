"""Best-fit packing with vector capacities.

Texts are encoded by the tokenizer whose counts `tokens` gives for every prefix.
An item is a document, or a part of at most `chunk` tokens of a longer one, with
three demands: tokens, one document, and attention cost (tokens squared). A bin
has a capacity for each. Items are taken by falling size; each goes to the open
bin that is feasible in every demand and best by the norm of the residual left
there (rule "norm") or by the weighted dot product of demand and residual (rule
"dot"); if none is feasible, a bin is opened.

Only numbers of items are packed; their tokens join them at the end, so that a
packed row has what it stands for: the rows of a bin by (doc_id, part) are its
content, and no bin has more tokens than its capacity.

Shards of about SHARD_ITEMS items, by a hash, are packed side by side.
The items of bins that stayed under FULL go on to the next round, in a sixteenth
of the shards, until one shard is left, so the waste of the shards' last bins
doesn't add up. Items are numbered and kept before they are packed, so a lost task gives
the same bins again.

Defined results: a null or empty text has no tokens and gets one row with a null
bin; a null id is an item like any other; repeated rows are items of their own;
a very long text is cut into as many parts as it takes; ties go to the older
bin, and items of one size go by (id, part); an empty table gives no rows; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import tokens as prefix
from quillspan.llm.common import buffers, cut, read, release

TOKENS, DOCUMENTS, CHUNK = 4096, 32, 2048
#: Three quarters of what two full parts side by side would cost.
ATTENTION = 3 * CHUNK * CHUNK // 2
SHARD_ITEMS = 16_384
FULL = 0.97
NO_ID = -(1 << 63)


def best_fit(tokens: np.ndarray, capacity: tuple[int, int, int], rule: str = "norm") -> np.ndarray:
    """The bin of each item; items in the order in which they are to be placed."""
    cap = np.asarray(capacity, float)
    need = np.stack([tokens, np.ones(len(tokens)), tokens.astype(float) ** 2], axis=1) / cap
    weight = need.mean(axis=0) if len(need) else np.ones(3)
    weight = weight / max(weight.sum(), 1e-12)
    left = np.empty((max(16, len(need)), 3))
    name = np.empty(len(left), np.int64)
    n = made = 0
    smallest = np.minimum.accumulate(need[::-1], axis=0)[::-1] if len(need) else need
    out = np.empty(len(need), np.int64)
    for i, x in enumerate(need):
        if i % 256 == 0 and n:  # bins that no later item fits
            open_ = (left[:n] + 1e-12 >= smallest[i]).all(axis=1)
            k = int(open_.sum())
            left[:k], name[:k], n = left[:n][open_], name[:n][open_], k
        rest = left[:n] - x
        ok = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(ok):
            score = (rest[ok] ** 2) @ weight if rule == "norm" else -(left[ok] @ (weight * x))
            b = ok[np.argmin(score)]
        else:
            b, n = n, n + 1
            left[b], name[b] = 1.0, made
            made += 1
        left[b] -= x
        out[i] = name[b]
    return out


_encoders: dict[str, object] = {}


def encoder(vocabulary: str = prefix.VOCABULARY):
    """The library's encoder of this vocabulary, with the pre-tokenizer of `tokens`."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("pack", pat_str=prefix.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _kind(vocabulary: str) -> str:
    """How tokens travel: in two bytes where the vocabulary allows it."""
    return "<u2" if encoder(vocabulary).max_token_value < 1 << 16 else "<u4"


#: Rows that are encoded at once.
ROWS = 1024
ITEMS = "id long, part int, start long, n_tokens long, tokens binary"


def items(docs: DataFrame, chunk: int = CHUNK, vocabulary: str = prefix.VOCABULARY) -> DataFrame:
    """(id, part, start, n_tokens, tokens) of all parts of the documents; tokens as bytes of _kind."""

    def run(batches):
        enc, kind = encoder(vocabulary), _kind(vocabulary)
        for big in batches:
            for a in range(0, big.num_rows, ROWS):
                b = big.slice(a, ROWS)
                out: list[list] = [[], [], [], [], []]
                for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                    tok = np.array(enc.encode_ordinary(t) if t else (), kind)
                    for part in range(max(1, -(-len(tok) // chunk))):
                        own = tok[part * chunk : (part + 1) * chunk]
                        for o, x in zip(out, (i, part, part * chunk, len(own), own.tobytes())):
                            o.append(x)
                release()
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, ty) for o, ty in zip(out, types)], names=[x.split()[0] for x in ITEMS.split(", ")])

    whole = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    return whole.mapInArrow(run, ITEMS)


def _lists(kind: str):
    wide = np.dtype(kind).itemsize

    def run(batches):
        for b in batches:
            flat, offs = buffers(b["tokens"])
            lists = pa.ListArray.from_arrays(pa.array((offs // wide).astype(np.int32)), pa.array(np.frombuffer(flat.tobytes(), kind).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists if n == "tokens" else c for n, c in zip(b.schema.names, b.columns)], names=b.schema.names)

    return run


def pack(docs: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, attention: int = ATTENTION, chunk: int = CHUNK, rule: str = "norm", shard_items: int = SHARD_ITEMS, vocabulary: str = prefix.VOCABULARY) -> DataFrame:
    """(bin_id, doc_id, part, start, n_tokens, tokens): every token of every document in exactly one bin; start is the place of the part's first token."""
    if chunk > tokens or chunk * chunk > attention or documents < 1:
        raise ValueError("a full part must fit an empty bin")
    cap = (tokens, documents, attention)
    every = cut(items(docs, chunk, vocabulary).withColumn("uid", F.monotonically_increasing_id()))
    todo = every.where("n_tokens > 0").select("uid", "id", "part", "n_tokens")
    shards = max(1, -(-todo.count() // shard_items))
    schema = "bin_id long, uid long, id long, part int, n_tokens long, done boolean"
    done, base = [], 0
    while True:
        last = shards == 1

        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            tok, uid, ids, part = (t[c].to_numpy() for c in ("n_tokens", "uid", "id", "part"))
            order = np.lexsort((uid, part, ids, -tok))
            b = best_fit(tok[order], cap, rule)
            t = t.select(["uid", "id", "part", "n_tokens"]).take(pa.array(order))
            fill = np.zeros((int(b.max()) + 1, 3))
            np.add.at(fill, b, np.stack([tok[order] / cap[0], np.full(len(b), 1 / cap[1]), tok[order].astype(float) ** 2 / cap[2]], axis=1))
            ready = np.ones(len(b), bool) if last else (fill.max(axis=1) >= FULL)[b]
            name = (np.int64(key[0].as_py()) << 32) + b
            return pa.table([pa.array(name), *t.columns, pa.array(ready)], names=["bin_id", "uid", "id", "part", "n_tokens", "done"])

        keyed = todo.withColumn("shard", F.lit(base) + F.pmod(F.xxhash64("uid"), F.lit(shards)))
        placed = keyed.groupBy("shard").applyInArrow(run, schema)
        if last:
            done.append(placed.drop("done"))
            break
        placed = cut(placed)
        done.append(placed.where("done").drop("done"))
        todo = placed.where("NOT done").drop("done", "bin_id")
        base, shards = base + shards, -(-shards // 16)
    bins = done[0].select("uid", "bin_id")
    for d in done[1:]:
        bins = bins.unionByName(d.select("uid", "bin_id"))
    out = every.join(bins, "uid", "left").select("bin_id", F.expr(f"nullif(id, {NO_ID}L)").alias("doc_id"), "part", "start", "n_tokens", "tokens")
    return out.mapInArrow(_lists(_kind(vocabulary)), "bin_id long, doc_id long, part int, start long, n_tokens long, tokens array<int>")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
