"""Quality classifier: supervised subword embeddings.

Each hashed word, pair of neighbouring words and character n-gram has a learned
vector; a document is the average of its vectors, and a softmax over a linear
layer gives the probability of each class. Embeddings and layer are trained by
minibatch stochastic gradient descent in numpy on a bounded sample of labelled
rows. Since the layer is linear, inference sums one number a gram and class,
`embedding @ layer`, over the whole text.

Classes: 0 clean, 1 junk (label quality = 0).

Defined results: a null or empty text has no grams, its probability of junk is 0
and it isn't rejected; a null id is carried along; labels
that are null or whose document is missing aren't trained on, an id with
conflicting labels counts as junk, and of rows that repeat a labelled id one is trained on; without any
labels of a class, nothing is rejected. Rows that repeat are scored each; a very
long text is averaged whole; a probability of exactly the threshold is junk; an
empty table gives no rows; all columns are kept, also one called p_junk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspan.llm.common import LOWER, buffers, read, release, slices, span_hashes, word_spans

BUCKET_BITS = 17
DIM = 8
NGRAMS = (3, 4, 5)
#: Bound of the labelled sample, for each class. The only sample here; inference covers all rows.
SAMPLE_PER_CLASS = 300
EPOCHS = 8
#: A document is rejected from this probability of junk on.
THRESHOLD = 0.5


def _gram_buckets(low: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n bytes from each position on."""
    x = low.astype(np.uint32)
    m = len(x) - n + 1
    h = x[:m].copy()
    for k in range(1, n):
        h *= np.uint32(0x01000193)
        h ^= x[k : k + m]
    h *= np.uint32(0x9E3779B1 + 2 * n)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def features(raw: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Kinds of features as (bucket at each place, first place of each row, end of each row)."""
    low = LOWER[raw]
    out = []
    for n in NGRAMS:
        b = _gram_buckets(low, n) if len(low) >= n else np.zeros(0, np.int32)
        lo = np.minimum(offs[:-1], len(b))
        out.append((b, lo, np.maximum(lo, np.minimum(offs[1:] - n + 1, len(b)))))
    start, end, row = word_spans(raw, offs)
    h = span_hashes(low, start, end) if len(start) else np.zeros(0, np.uint64)
    at = np.searchsorted(row, np.arange(len(offs)))
    shift = np.uint64(64 - BUCKET_BITS)
    out.append(((h >> shift).astype(np.int32), at[:-1], at[1:]))
    pair = h[1:] - h[:-1]  # a repeated word is always the same pair
    pair = (pair * np.uint64(0x9FB21C651E98DF25)) >> shift
    out.append((pair.astype(np.int32), np.minimum(at[:-1], len(pair)), np.maximum(np.minimum(at[:-1], len(pair)), np.minimum(at[1:] - 1, len(pair)))))
    return out


@dataclass
class Model:
    table: np.ndarray  # float32, buckets x classes
    bias: np.ndarray

    def logits(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n, k = len(offs) - 1, len(self.bias)
        total, count = np.zeros((n, k)), np.zeros(n)
        for b, lo, hi in features(raw, offs):
            count += hi - lo
            for c in range(1, k):  # class 0 is the reference
                acc = np.zeros(len(b) + 1)
                np.cumsum(self.table[:, c][b], out=acc[1:], dtype=np.float64)
                total[:, c] += acc[hi] - acc[lo]
        z = total / np.maximum(count, 1)[:, None] + self.bias
        z[count == 0, 1:] = -np.inf
        return z

    def probabilities(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.logits(raw, offs)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _document_grams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, weights) of each text; weights add up to 1."""
    raw, offs = buffers(pa.array(texts, pa.large_string()))
    out = []
    for a, b in slices(offs):
        kinds = features(raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        for i in range(b - a):
            ids, n = np.unique(np.concatenate([x[lo[i] : hi[i]] for x, lo, hi in kinds]), return_counts=True)
            out.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(texts: list[str], classes: list[int], k: int = 2, epochs: int = EPOCHS, seed: int = 7, rate: float = 8.0) -> Model:
    """Averaged embeddings and a softmax layer by minibatch SGD; class weights undo the sample's balance."""
    y = np.asarray(classes)
    if len(set(classes)) < 2:
        return Model(np.zeros((1 << BUCKET_BITS, k), np.float32), np.array([8.0] + [0.0] * (k - 1)))
    rng = np.random.default_rng(seed)
    grams = _document_grams(texts)
    emb = rng.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    lay, bias = rng.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    size = 16
    steps, done = epochs * -(-len(y) // size), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), size):
            rows = order[a : a + size]
            ids = np.concatenate([grams[i][0] for i in rows])
            w = np.concatenate([grams[i][1] for i in rows])
            owner = np.repeat(np.arange(len(rows)), [len(grams[i][0]) for i in rows])
            doc = np.zeros((len(rows), DIM), np.float32)
            for d in range(DIM):
                doc[:, d] = np.bincount(owner, w * emb[ids, d], len(rows))
            z = doc @ lay + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            lr = rate * (1 - done / steps) / len(rows)
            back = (p @ lay.T) * lr
            lay -= lr * 0.1 * doc.T @ p
            bias -= lr * 0.1 * p.sum(axis=0)
            step = back[owner] * (w * 40)[:, None]
            np.subtract.at(emb, ids, step) if len(rows) < 2 else _scatter(emb, ids, step)
            done += 1
    table = emb @ lay
    table -= table[:, :1]
    return Model(np.ascontiguousarray(table.astype(np.float32)), (bias - bias[0]).astype(np.float64))


def _scatter(emb: np.ndarray, ids: np.ndarray, step: np.ndarray) -> None:
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    emb[s[first]] -= np.add.reduceat(step[order], first, axis=0)


def sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[str], list[int]]:
    """At most per_class labelled texts of each class, by a hash of their ids, with their classes."""
    lab = labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("cls")).where("id IS NOT NULL AND cls IS NOT NULL")
    lab = lab.groupBy("id").agg(F.max("cls").alias("cls"))
    picked: dict[int, int] = {}
    for c in (0, 1):
        picked |= {r.id: c for r in lab.where(F.col("cls") == c).orderBy(F.xxhash64("id"), "id").select("id").limit(per_class).collect()}
    rows = docs.where(F.col("doc_id").isin(list(picked)) & F.col("text").isNotNull()).select("doc_id", "text").collect() if picked else []
    rows = sorted({r.doc_id: r.text for r in rows}.items())
    return [t for _, t in rows], [picked[i] for i, _ in rows]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    return train(*sample(docs, labels, per_class))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and a last one, the probability of junk from the whole text: p_junk, or with underscores before it where docs has that."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets x classes
    name = "p_junk"
    while name in (c.lower() for c in docs.columns):
        name = "_" + name

    def run(batches):
        m = shared.value
        for b in batches:
            raw, offs = buffers(b["text"])
            p = np.concatenate([np.zeros(0)] + [m.probabilities(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[:, 1] for i, j in slices(offs)])
            release()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p_junk, keep) of every row."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", F.round("p_junk", 6).alias("p_junk"), (F.col("p_junk") < threshold).alias("keep"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns."""
    out = score(docs, fit(docs, labels))
    return out.where(out[out.columns[-1]] < threshold).drop(out.columns[-1])


def query(spark, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
