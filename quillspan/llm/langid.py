"""Language of every word in code-switched text by a linear-chain conditional random field.

Each word (a run of letters and digits) has hashed features: the word, prefixes
and suffixes of up to four bytes, its character trigrams, and its place in a
lexicon of each language's commonest words, which is learned from the sample.
Weights and transitions are trained together by stochastic gradient on the
conditional likelihood, over sequences from labelled documents, half of them
switched between languages. Labelling takes each word's best posterior from
forward-backward over the whole document: transfer matrices of blocks of words
are multiplied side by side, the blocks of a document are chained, and the
positions inside follow from the blocks' ends, which is exact.

Defined results: a null text, and one without a word, has no language and no
spans; a null id is carried along; documents without a lang aren't trained on;
with one language in the sample every word has it, and with none no word has
any, nor without a column lang. Ties go to the language that is first by name.
Rows that repeat are labelled each; a very long text is labelled whole, in blocks;
an empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.common import BYTE_CODES, LOWER, buffers, mix64, powers, read, release, slices, spread, word_spans

BITS = 16
AFFIXES = (1, 2, 3, 4)
#: Bound of the labelled sample: documents of each language, and words of each. Labelling covers all text.
SAMPLE_DOCS, SAMPLE_WORDS = 80, 20_000
LEXICON = 200
SEQUENCES, LENGTH, EPOCHS = 2400, 48, 5
BLOCK = 64


def word_features(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, affix and word buckets as kinds x words, trigram bucket at each byte)."""
    p, inv = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(BYTE_CODES[low] * p[:-1], out=total[1:])
    shift = np.uint64(64 - BITS)

    def span(a, b, kind):
        return (((total[b] - total[a]) * inv[a] + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int32)

    word = mix64((total[end] - total[start]) * inv[start])
    kinds = [(word >> shift).astype(np.int32)]
    for k in AFFIXES:
        kinds.append(span(start, np.minimum(start + k, end), 2 * k))
        kinds.append(span(np.maximum(end - k, start), end, 2 * k + 1))
    x = low.astype(np.uint32)
    tri = np.zeros(len(low), np.int32)
    if len(x) > 2:
        g = (x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        tri[:-2] = ((g ^ g >> np.uint32(13)) * np.uint32(0x85EBCA77) >> np.uint32(32 - BITS)).astype(np.int32)
    return word, np.stack(kinds), tri


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # float32, languages x buckets
    lexicon: np.ndarray  # sorted word hashes
    lexical: np.ndarray  # float32, languages x lexicon entries: the weight of an entry, last column none
    trans: np.ndarray  # log transitions

    def emissions(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        word, kinds, tri = word_features(low, start, end)
        at = np.minimum(np.searchsorted(self.lexicon, word), max(len(self.lexicon) - 1, 0))
        slot = np.where(self.lexicon[at] == word, at, len(self.lexicon)) if len(self.lexicon) else np.zeros(len(word), np.int64)
        out = np.empty((len(word), len(self.langs)))
        last = np.maximum(end - 2, start)
        acc = np.zeros(len(low) + 1)
        for c, w in enumerate(self.weights):
            np.cumsum(w[tri], out=acc[1:], dtype=np.float64)
            e = acc[last] - acc[start]
            for k in kinds:
                e += w[k]
            out[:, c] = e + self.lexical[c][slot]
        return out


def posteriors(e: np.ndarray, trans: np.ndarray, size: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginals of every position of sequences of these sizes (none 0), emissions one after the other."""
    k = e.shape[1]
    x = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    begin = np.cumsum(size) - size
    blocks = -(-size // block)
    seq = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(len(seq)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = begin[seq] + number * block
    n = np.minimum(block, size[seq] - number * block)
    order = np.argsort(-n, kind="stable")  # by falling length, so that the blocks still open are a prefix
    at_o, n_o = at[order], n[order]
    open_ = np.searchsorted(-n_o, -np.arange(block), side="left")  # blocks longer than a step
    # transfer matrix of each block: from the state before it to the state at its end
    m = np.broadcast_to(np.eye(k), (len(at_o), k, k)).copy()
    for s in range(block):
        c = open_[s]
        if not c:
            break
        step = (m[:c].reshape(-1, k) @ t).reshape(c, k, k)
        if s == 0:
            step[(number == 0)[order][:c]] = 1.0  # nothing leads into the first position of a sequence
        step *= x[at_o[:c] + s][:, None, :]
        m[:c] = step / step.max(axis=(1, 2), keepdims=True)
    full = np.empty_like(m)
    full[order] = m
    # chain the blocks of each sequence, forward and backward; sequences by falling number of blocks
    before, after = np.ones((len(seq), k)), np.ones((len(seq), k))
    by = np.argsort(-blocks, kind="stable")
    first, many = (np.cumsum(blocks) - blocks)[by], blocks[by]
    for s in range(int(many.max()) - 1):
        c = int(np.searchsorted(-many, -(s + 1), side="left"))
        i, j = first[:c] + s, (first + many - 1)[:c] - s
        f = np.einsum("ik,ikl->il", before[i], full[i])
        before[i + 1] = f / f.max(axis=1, keepdims=True)
        b = np.einsum("ikl,il->ik", full[j], after[j])
        after[j - 1] = b / b.max(axis=1, keepdims=True)
    fwd = np.empty_like(x)
    a = before[order].copy()
    starts = (number == 0)[order]
    for s in range(block):
        c = open_[s]
        if not c:
            break
        step = a[:c] @ t
        if s == 0:
            step[starts[:c]] = 1.0
        step *= x[at_o[:c] + s]
        a[:c] = step / step.sum(axis=1, keepdims=True)
        fwd[at_o[:c] + s] = a[:c]
    b = after[order].copy()
    for s in range(block - 1, -1, -1):
        c = open_[s]
        if not c:
            continue
        fwd[at_o[:c] + s] *= b[:c]
        step = (b[:c] * x[at_o[:c] + s]) @ t.T
        b[:c] = step / step.max(axis=1, keepdims=True)
    return fwd / fwd.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    langs = sorted(set(labels))
    k = len(langs)
    if k < 2:
        return Model(langs, np.zeros((k, 1 << BITS), np.float32), np.zeros(0, np.uint64), np.zeros((k, 1), np.float32), np.zeros((k, k)))
    rng = np.random.default_rng(seed)
    raw, offs = buffers(pa.array(texts, pa.large_string()))
    low = LOWER[raw]
    start, end, row = word_spans(raw, offs)
    lang = np.array([langs.index(x) for x in labels])[row]
    pool = [np.flatnonzero(lang == c)[:SAMPLE_WORDS] for c in range(k)]
    word, kinds, tri = word_features(low, start, end)
    common: Counter = Counter()
    for c in range(k):
        values, n = np.unique(word[pool[c]], return_counts=True)
        common.update(values[np.argsort(-n, kind="stable")[:LEXICON]].tolist())
    lexicon = np.array(sorted(common), np.uint64)
    at = np.minimum(np.searchsorted(lexicon, word), len(lexicon) - 1)
    slot = np.where(lexicon[at] == word, at, len(lexicon))
    seqs, gold = [], []
    for i in range(SEQUENCES):
        left, c = LENGTH, int(rng.integers(k))
        idx, y = [], []
        while left:
            n = left if i % 2 == 0 else min(left, int(rng.integers(3, 20)))
            if len(pool[c]):
                s = int(rng.integers(max(1, len(pool[c]) - n)))
                take = pool[c][s : s + n]
                idx.append(np.resize(take, n))
                y.append(np.full(n, c))
                left -= n
            c = (c + 1 + int(rng.integers(k - 1))) % k
        seqs.append(np.concatenate(idx))
        gold.append(np.concatenate(y))
    seqs, gold = np.stack(seqs), np.stack(gold)
    w, lx, tr = np.zeros((k, 1 << BITS)), np.zeros((k, len(lexicon) + 1)), np.zeros((k, k))
    hw, hl, ht = np.full_like(w, 1e-6), np.full_like(lx, 1e-6), np.full_like(tr, 1e-6)
    size = 200
    tri_n = np.maximum(end - 2, start) - start
    for _ in range(EPOCHS):
        order = rng.permutation(SEQUENCES)
        for a in range(0, SEQUENCES, size):
            ii, y = seqs[order[a : a + size]], gold[order[a : a + size]]
            flat = ii.reshape(-1)
            tb = tri[spread(start[flat], tri_n[flat])]
            owner = np.repeat(np.arange(len(flat)), tri_n[flat])
            e = np.empty((len(flat), k))
            for c in range(k):
                e[:, c] = w[c][kinds[:, flat]].sum(axis=0) + lx[c][slot[flat]] + np.bincount(owner, w[c][tb], len(flat))
            e3 = e.reshape(*ii.shape, k)
            # forward-backward over all sequences at once, with pair marginals for the transitions
            x, t = np.exp(e3 - e3.max(axis=2, keepdims=True)), np.exp(tr)
            al, be = np.empty_like(x), np.ones_like(x)
            al[:, 0] = x[:, 0] / x[:, 0].sum(axis=1, keepdims=True)
            for s in range(1, LENGTH):
                v = (al[:, s - 1] @ t) * x[:, s]
                al[:, s] = v / v.sum(axis=1, keepdims=True)
            for s in range(LENGTH - 2, -1, -1):
                v = (be[:, s + 1] * x[:, s + 1]) @ t.T
                be[:, s] = v / v.sum(axis=1, keepdims=True)
            post = al * be
            post /= post.sum(axis=2, keepdims=True)
            pair = al[:, :-1, :, None] * t * (x * be)[:, 1:, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            gt = pair.sum(axis=(0, 1))
            np.subtract.at(gt, (y[:, :-1].reshape(-1), y[:, 1:].reshape(-1)), 1)
            g = post.reshape(-1, k)
            g[np.arange(len(g)), y.reshape(-1)] -= 1
            for c in range(k):
                gw = np.bincount(kinds[:, flat].reshape(-1), np.tile(g[:, c], len(kinds)), 1 << BITS) + np.bincount(tb, g[owner, c], 1 << BITS)
                gw = gw / size + 1e-6 * w[c]
                hw[c] += gw * gw
                w[c] -= 0.1 * gw / np.sqrt(hw[c])
                gl = np.bincount(slot[flat], g[:, c], len(lexicon) + 1) / size
                hl[c] += gl * gl
                lx[c] -= 0.1 * gl / np.sqrt(hl[c])
            gt /= size
            ht += gt * gt
            tr -= 0.1 * gt / np.sqrt(ht)
    return Model(langs, w.astype(np.float32), lexicon, lx.astype(np.float32), tr)


def label_words(model: Model, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, label, posterior) of every word."""
    start, end, row = word_spans(raw, offs)
    if not len(start) or not model.langs:
        return row[:0], np.zeros(0, np.int64), np.zeros(0)
    e = model.emissions(LOWER[raw], start, end)
    size = np.bincount(row, minlength=len(offs) - 1)
    p = posteriors(e, model.trans, size[size > 0])
    best = p.argmax(axis=1)
    return row, best, p[np.arange(len(best)), best]


def fit(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> Model:
    if "lang" not in docs.columns:
        return train([], [])
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL")
    # one scan; each task passes on at most per_lang rows of a language
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = [r.doc_id for r in known.select("doc_id", "lang").withColumn("nth", nth).where(F.col("nth") <= per_lang).select("doc_id").collect()]
    rows = known.where(F.col("doc_id").isin(ids)).select("doc_id", "lang", "text").collect() if ids else []
    rows = sorted({r.doc_id: (r.text, r.lang) for r in rows}.items())
    return train([t for _, (t, _) in rows], [x for _, (_, x) in rows])


def identify(docs: DataFrame, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, language, n_words, confidence, spans) of every row; a span is (first word, end, language)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_lang))  # of fixed size: languages x buckets

    def run(batches):
        m = model.value
        names = np.array(m.langs + [""], object)
        for b in batches:
            release()
            raw, offs = buffers(b["text"])
            for i, j in slices(offs):
                row, lab, p = label_words(m, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = j - i
                words = np.bincount(row, minlength=n)
                votes = np.zeros((n, max(1, len(m.langs))), np.int64)
                np.add.at(votes, (row, lab), 1)
                sure = np.bincount(row, p, n) / np.maximum(words, 1)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (lab[1:] != lab[:-1])
                first = np.flatnonzero(new)
                before = (np.cumsum(words) - words)[row[first]]
                stop = np.append(first[1:], len(row)) - before
                span = pa.StructArray.from_arrays([pa.array((first - before).astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(names[lab[first]], pa.string())], names=["start", "end", "lang"])
                per = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=n))]).astype(np.int32)
                top = [names[v] if c else None for v, c in zip(votes.argmax(axis=1).tolist(), words.tolist())]
                cols = [b["doc_id"][i:j], pa.array(top, pa.string()), pa.array(words.astype(np.int64)), pa.array(np.where(words > 0, np.round(sure, 6), np.nan), mask=words == 0), pa.ListArray.from_arrays(pa.array(per), span)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "language", "n_words", "confidence", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, language string, n_words long, confidence double, spans array<struct<start:int,end:int,lang:string>>")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
