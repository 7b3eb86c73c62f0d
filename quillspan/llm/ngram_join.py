"""N-gram Jaccard self-join with a prefix tree.

A document is the set of its word n-grams, as hashes (words are runs of
letters and digits, ASCII case folded). The join finds every pair of different
sets whose Jaccard similarity reaches the threshold t; it is exact but for
collisions of the hash.

1. Parts of the table of about FLUSH n-grams (flushes) keep each different set
   once, and send their distinct n-grams, with counts, to hash ranges. A range
   adds the counts up, for each n-gram over the whole table, and answers every
   flush; so an n-gram or a set that a third of all rows have is one entry a
   flush there. Sets go the same way: the flush with the least id keeps the set.
2. A set that f flushes have shares an n-gram with another one only if the
   n-gram's count is over f; the rest can't match and is dropped. A set of size s
   has a partner only if at least ceil(t*s) are left, so most sets end here.
   Global order is (count, hash), rarest first; sets that share an n-gram of their
   prefixes of s - ceil(t*s) + 1 n-grams, those dropped counted, are connected.
3. Each connected component is joined by a trie over the ordered sets with
   compressed edges: overlaps are carried down shared paths, for many probes at
   once; a subtree is left if no prefix in it meets the probe's, or as soon as
   overlap plus the shorter remaining length can't reach what the sizes below
   require. Components of over BLOCK sets are cut into bands of sizes, of which
   only neighbours can match, and these into blocks joined block against block.
4. Each task links what it found; only components of several tasks are linked
   again over the table.

Defined results (`classes`): one row for each row of the table. A document
without a word and a null text have no partner and are their own class; a null
id has a null class and no links; a text of fewer than n words is one n-gram of
all its words, very long texts are sets like any other; a repeated row, or
another text of the same n-grams, is a copy that counts as a link; of ties the
smallest id names the class; an empty table gives no rows; other columns play no
part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import buffers, components, cut, linked, mix64, ngram_keys, packed, read, release, shards, slices, small, spread, unpacked

N = 3
THRESHOLD = 0.6
#: Estimated input bytes for each hash range.
RANGE_BYTES = 8 << 20
#: Bytes of a hash, up to so many ranges and beyond; either way less than one n-gram in 10,000 shares its hash with another one.
WIDTHS, FEW_RANGES = (6, 7), 1 << 12
#: N-grams that a task holds before it sends them, at least; with many ranges more, so that a row for a range stays long.
FLUSH, MOST_FLUSH, EACH_ROW = 1_000_000, 8_000_000, 64  # below 1 << 24, the numbers' width
#: Sets that are joined at once, and their n-grams.
BLOCK, BLOCK_GRAMS = 2048, 2_000_000
#: Places that the trie looks at in one step, and the size of the table of a group of probes.
STEP, TABLE = 4_000_000, 16_000_000


def _needed(t: float, size):
    return np.ceil(t * np.asarray(size, float) - 1e-9).astype(np.int64)


def _width(ranges: int) -> int:
    return WIDTHS[ranges > FEW_RANGES]


def _slice_sets(raw: np.ndarray, offs: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each of at most 256 rows, sorted by both."""
    row, key = ngram_keys(raw, offs, n)
    bits = np.uint64(8 * width)
    k = np.sort((row.astype(np.uint64) << bits) | (key >> (np.uint64(64) - bits)))
    if len(k):
        k = k[np.concatenate([[True], k[1:] != k[:-1]])]
    return (k >> bits).astype(np.int64), k & ((np.uint64(1) << bits) - np.uint64(1))


#: k: a hash range, or below 0 a place for what a flush keeps for itself. In a range's row: n-grams, their counts, sets, least ids, numbers of rows.
#: In a flush's own: numbers of n-grams set by set, sizes, sets, ids of its rows, numbers of their sets. Answers: n-grams, counts, for each set its flushes and rows, places.
SENT = "k int, flush long, lo int, grams binary, counts binary, sigs binary, ids binary, many binary"


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * 8
    types = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SENT.split(", ")])


def _sender(n: int, ranges: int):
    most, width = max(FLUSH, min(MOST_FLUSH, ranges * EACH_ROW)), _width(ranges)
    edges = np.arange(1, ranges, dtype=np.uint64)
    gram_edges, sig_edges = edges << np.uint64(8 * width - (ranges.bit_length() - 1)), edges << np.uint64(64 - (ranges.bit_length() - 1)) if ranges > 1 else edges

    def run(batches):
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush(name: int) -> pa.Table:
            ids, sizes, sigs, grams = (np.concatenate([h[i] for h in held]) for i in range(4))
            none = sizes == 0
            uniq, first, member = np.unique(sigs[~none], return_index=True, return_inverse=True)
            at = np.cumsum(sizes) - sizes
            at, sizes = at[~none][first], sizes[~none][first]
            many = np.bincount(member, minlength=len(uniq))
            least = np.full(len(uniq), np.iinfo(np.int64).max)
            np.minimum.at(least, member, ids[~none])
            own = grams[spread(at, sizes)]
            different, inv = np.unique(own, return_inverse=True)
            count = np.bincount(inv, minlength=len(different))
            gc = np.concatenate([[0], np.searchsorted(different, gram_edges), [len(different)]])
            sc = np.concatenate([[0], np.searchsorted(uniq, sig_edges), [len(uniq)]])
            whose = np.full(len(ids), -1, np.int32)
            whose[~none] = member
            rows = [(-1 - name % ranges, name, 0, packed(inv.astype(np.uint64), 3), sizes.astype(np.int32).tobytes(), uniq.tobytes(), ids.tobytes(), whose.tobytes())]
            for r in range(ranges):
                a, b, c, d = gc[r], gc[r + 1], sc[r], sc[r + 1]
                if a < b or c < d:
                    rows.append((r, name, int(a), packed(different[a:b], width), packed(count[a:b].astype(np.uint64), 4), uniq[c:d].tobytes(), least[c:d].tobytes(), many[c:d].astype(np.int64).tobytes()))
            return _table(rows)

        for b in batches:
            ident = b["id"].to_numpy(zero_copy_only=False).astype(np.int64)
            raw, offs = buffers(b["text"])
            for i, j in slices(offs, 256):
                row, h = _slice_sets(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], n, width)
                count = np.bincount(row, minlength=j - i)
                sig = np.zeros(j - i, np.uint64)
                if len(has := np.flatnonzero(count)):
                    sig[has] = mix64(np.add.reduceat(mix64(h + np.uint64(1)), np.searchsorted(row, has)) ^ count[has].astype(np.uint64))
                held.append((ident[i:j], count, sig, h))
                size += len(h) + j - i
                if size >= most:
                    out, size = flush((part << 32) + seq), 0
                    held, seq = [], seq + 1
                    release()
                    yield from out.to_batches()
        if held:
            out = flush((part << 32) + seq)
            held = []
            release()
            yield from out.to_batches()

    return run


def _runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, run of each place) of the runs that begin where new is true."""
    return np.flatnonzero(new), np.cumsum(new) - 1


def _counter(width: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        r = key[0].as_py()
        if r < 0:
            return t
        flush, lo = t["flush"].to_pylist(), t["lo"].to_pylist()
        counts = [unpacked(x.as_buffer(), 4).astype(np.int32) for x in t["counts"]]
        g_at = np.concatenate([[0], np.cumsum([len(x) for x in counts])])
        g, count = np.empty(g_at[-1], np.uint64), np.concatenate(counts)
        del counts
        for i in range(len(flush)):
            g[g_at[i] : g_at[i + 1]] = unpacked(t["grams"][i].as_buffer(), width)
        total = np.zeros(len(g), np.int64)
        if len(g):
            order = np.argsort(g)
            s = g[order]
            begin, run_ = _runs(np.concatenate([[True], s[1:] != s[:-1]]))
            del s
            total[order] = np.add.reduceat(count[order], begin, dtype=np.int64)[run_]
            del order, run_, count
        # of equal sets the one with the least id stays, of these that of the first flush
        sigs, ids, many = ([np.frombuffer(x.as_buffer(), k) for x in t[c]] for c, k in (("sigs", np.uint64), ("ids", np.int64), ("many", np.int64)))
        s_at = np.concatenate([[0], np.cumsum([len(x) for x in sigs])])
        sig, sid, sm = np.concatenate(sigs), np.concatenate(ids), np.concatenate(many)
        owner = np.repeat(np.array(flush, np.int64), np.diff(s_at))
        order = np.lexsort((owner, sid, sig))
        s = sig[order]
        flushes, rows = np.zeros(len(sig), np.int32), np.zeros(len(sig), np.int64)
        if len(sig):
            begin, run_ = _runs(np.concatenate([[True], s[1:] != s[:-1]]))
            flushes[order] = np.bincount(run_)[run_]
            rows[order[begin]] = np.add.reduceat(sm[order], begin)
        out = []
        for i, name in enumerate(flush):
            d = total[g_at[i] : g_at[i + 1]]
            keep = np.flatnonzero(d > 1)
            out.append((r, name, lo[i], packed(g[g_at[i] : g_at[i + 1]][keep], width), packed(d[keep].astype(np.uint64), 4), flushes[s_at[i] : s_at[i + 1]].tobytes(), rows[s_at[i] : s_at[i + 1]].tobytes(), packed(keep.astype(np.uint64), 3)))
        del g, total
        release()
        return _table(out)

    return run


#: A row for each document; n: rows of the set, at its least id alone, elsewhere 0; grams and ranks only there, and if the set can have a partner.
SETS = "id long, sig long, n long, size int, grams array<long>, ranks array<int>, prefix int"


def _assembler(t_min: float, width: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["k"].to_numpy(), kind="stable")
        k = t["k"].to_pylist()
        home, answers = int(order[0]), [int(i) for i in order if k[i] >= 0]
        get = lambda i, c, kind: np.frombuffer(t[c][i].as_py(), kind)
        size = get(home, "counts", np.int32).astype(np.int64)
        sigs, ids, whose = get(home, "sigs", np.uint64), get(home, "ids", np.int64), get(home, "many", np.int32).astype(np.int64)
        inv = unpacked(t["grams"][home].as_py(), 3).astype(np.int64)
        gram, count = np.zeros(int(inv.max(initial=-1)) + 1, np.uint64), np.zeros(int(inv.max(initial=-1)) + 1, np.int64)
        for i in answers:
            at = unpacked(t["many"][i].as_py(), 3).astype(np.int64) + t["lo"][i].as_py()
            gram[at], count[at] = unpacked(t["grams"][i].as_py(), width), unpacked(t["counts"][i].as_py(), 4)
        cat = lambda c, kind: np.concatenate([np.zeros(0, kind), *(get(i, c, kind) for i in answers)])
        flushes, rows = cat("sigs", np.int32).astype(np.int64), cat("ids", np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        live = (count[inv] > flushes[owner]) & (rows[owner] > 0)
        total = np.bincount(owner[live], minlength=len(size))
        alive = (rows > 0) & (total >= np.maximum(_needed(t_min, size), 1))
        live &= alive[owner]
        at, owner = inv[live], owner[live]
        order = np.lexsort((gram[at], count[at], owner))
        at, owner = at[order], owner[order]
        # of the prefix, the n-grams of no other set come first and can't match
        prefix = np.where(alive, size - _needed(t_min, size) + 1 - (size - total), 0)
        # a set's row is that of its least id
        first = np.full(len(size), -1)
        by = np.lexsort((ids, whose))
        by = by[whose[by] >= 0]
        new = np.ones(len(by), bool)
        new[1:] = whose[by][1:] != whose[by][:-1]
        first[whose[by][new]] = by[new]
        main = np.zeros(len(ids), bool)
        main[first[rows > 0]] = True
        has, real = main & (whose >= 0), whose >= 0
        w = np.where(real, whose, 0)
        lo, hi = np.searchsorted(owner, np.arange(len(size))), np.searchsorted(owner, np.arange(len(size)), side="right")
        many = np.where(has, (hi - lo)[w] if len(size) else 0, 0)
        offs = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        where = at[spread(lo[w][has], many[has])] if len(size) else at
        pick = lambda x: np.where(has, x[w], 0) if len(size) else np.zeros(len(ids), np.int64)
        cols = [
            pa.array(ids), pa.array(sigs.view(np.int64)[w] if len(size) else np.zeros(len(ids), np.int64), mask=~real), pa.array(pick(rows)), pa.array(pick(size).astype(np.int32)),
            pa.ListArray.from_arrays(offs, pa.array(gram[where].astype(np.int64))), pa.ListArray.from_arrays(offs, pa.array(np.minimum(count[where], 2**31 - 1).astype(np.int32))),
            pa.array(pick(prefix).astype(np.int32)),
        ]
        return pa.table(cols, names=[x.split()[0] for x in SETS.split(", ")])

    return run


class Trie:
    """Ordered sets of small integers as a trie with compressed edges; level by level in flat arrays."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=keys.__getitem__)
        self.order, self.sizes = np.array(order, np.int64), sizes[order]
        self.text = np.concatenate([sets[i] for i in order]) if order else np.zeros(0, np.int64)
        self.length = length = np.array([len(sets[i]) for i in order], np.int64)
        self.begin = np.cumsum(length) - length
        shared = np.zeros(len(order), np.int64)  # common path with the set before
        for k in range(1, len(order)):
            a, b = sets[order[k - 1]], sets[order[k]]
            m = min(len(a), len(b))
            diff = np.flatnonzero(a[:m] != b[:m])
            shared[k] = diff[0] if len(diff) else m
        #: rows of a level: sets from, to, path before, path after, sets that end after it up to, longest, least and greatest size, children from, to
        self.levels: list[np.ndarray] = []
        nodes = [(0, len(order), 0, -1)] if order else []
        while nodes:
            rows, nxt = [], []
            for a, b, depth, parent in nodes:
                cuts = [a, *(a + 1 + np.flatnonzero(shared[a + 1 : b] <= depth)).tolist(), b]
                if parent >= 0:
                    self.levels[-1][parent, 8:] = len(rows), len(rows) + len(cuts) - 1
                for x, y in zip(cuts[:-1], cuts[1:]):
                    deep = int(min(length[x], shared[x + 1 : y].min())) if y - x > 1 else int(length[x])
                    z = x
                    while z < y and length[z] == deep:
                        z += 1
                    if z < y:
                        nxt.append((z, y, deep, len(rows)))
                    rows.append((x, y, depth, deep, z, int(length[x:y].max()), int(self.sizes[x:y].min()), int(self.sizes[x:y].max()), 0, 0))
            self.levels.append(np.array(rows, np.int64))
            nodes = nxt


def _meeting(left: Trie, l_prefix: np.ndarray, right: Trie, r_prefix: np.ndarray, a: int, b: int, t: float, own: bool) -> np.ndarray:
    """Whether the prefix of each of the probes a to b of left has an n-gram of the prefix of each set of right, and the sizes allow a match."""
    rw = np.repeat(np.arange(len(r_prefix)), r_prefix)
    rg = right.text[spread(right.begin, r_prefix)]
    order = np.argsort(rg, kind="stable")
    rg, rw = rg[order], rw[order]
    lw = np.repeat(np.arange(b - a), l_prefix[a:b])
    lg = left.text[spread(left.begin[a:b], l_prefix[a:b])]
    lo, hi = np.searchsorted(rg, lg), np.searchsorted(rg, lg, side="right")
    many = hi - lo
    out = np.zeros((b - a, len(r_prefix)), bool)
    upto, i = np.cumsum(many), 0
    while i < len(many):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + STEP, side="right")))
        out[np.repeat(lw[i:j], many[i:j]), rw[spread(lo[i:j], many[i:j])]] = True
        i = j
    x, y = left.sizes[a:b, None], right.sizes[None]
    out &= (y >= t * x - 1e-9) & (x >= t * y - 1e-9)
    if own:
        out &= np.arange(len(r_prefix)) > np.arange(a, b)[:, None]
    return out


def probe_all(left: Trie, l_prefix: np.ndarray, right: Trie, r_prefix: np.ndarray, top: int, t: float, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probe, set, overlap) of all matches, both by place in their tries; own: right is left, and each pair is wanted once."""
    found: list[tuple[np.ndarray, ...]] = []
    group = max(1, min(512, TABLE // max(top, 1), TABLE // max(len(r_prefix), 1)))
    for a in range(0, len(l_prefix), group):
        b = min(len(l_prefix), a + group)
        meet = _meeting(left, l_prefix, right, r_prefix, a, b, t, own)
        upto = np.zeros((b - a, len(r_prefix) + 1), np.int32)
        np.cumsum(meet, axis=1, out=upto[:, 1:])
        mark = np.zeros((b - a) * top, bool)
        mark[np.repeat(np.arange(b - a) * top, left.length[a:b]) + left.text[left.begin[a] : left.begin[b - 1] + left.length[b - 1]]] = True
        p, at, over = np.repeat(np.arange(b - a), len(right.levels[0])), np.tile(np.arange(len(right.levels[0])), b - a), np.zeros((b - a) * len(right.levels[0]), np.int64)
        for level in right.levels:
            node = level[at]
            go = upto[p, node[:, 1]] > upto[p, node[:, 0]]
            p, node, over = p[go], node[go], over[go]
            if not len(p):
                break
            span = node[:, 3] - node[:, 2]
            lo, ends, i = right.begin[node[:, 0]] + node[:, 2], np.cumsum(span), 0
            while i < len(p):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, side="right")))
                hit = mark[np.repeat(p[i:j] * top, span[i:j]) + right.text[spread(lo[i:j], span[i:j])]]
                over[i:j] += np.add.reduceat(hit, ends[i:j] - span[i:j] - (ends[i - 1] if i else 0), dtype=np.int64)
                i = j
            # what the remaining lengths allow, and the least that any size below requires
            size, length = left.sizes[a + p], left.length[a + p]
            most = over + np.minimum(node[:, 5] - node[:, 3], length - over)
            need = np.ceil(t / (1 + t) * (size + np.maximum(node[:, 6], np.ceil(t * size - 1e-9))) - 1e-9)
            go = most >= need
            p, node, over = p[go], node[go], over[go]
            many = node[:, 4] - node[:, 0]
            s, q, o = spread(node[:, 0], many), np.repeat(p, many), np.repeat(over, many)
            ok = meet[q, s] & (o >= t * (left.sizes[a + q] + right.sizes[s] - o) - 1e-9)
            found.append((a + q[ok], s[ok], o[ok]))
            many = node[:, 9] - node[:, 8]
            at, p, over = spread(node[:, 8], many), np.repeat(p, many), np.repeat(over, many)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def join_sets(left: list[tuple[np.ndarray, int, int]], right: list[tuple[np.ndarray, int, int]] | None, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of left against right, or of left against itself with i < j; sets are (ordered ranks, full size, prefix)."""
    tries = [Trie([s for s, *_ in side], np.array([z for _, z, _ in side], np.int64)) for side in (left, right) if side is not None]
    prefix = [np.array([side[i][2] for i in trie.order], np.int64) for side, trie in zip((left, right), tries)]
    top = 1 + max([int(s.max()) for s, *_ in [*left, *(right or [])] if len(s)], default=0)
    a, b = tries[0], tries[-1]
    p, s, o = probe_all(a, prefix[0], b, prefix[-1], top, t, right is None)
    i, j, jac = a.order[p], b.order[s], o / (a.sizes[p] + b.sizes[s] - o)
    if right is None:
        i, j = np.minimum(i, j), np.maximum(i, j)
    return i, j, jac


#: Of each set with a link: the least (id, set) that the task linked it with, and the rows of the sets linked with it.
LINKS = "sig long, to long, to_id long, links long, wide boolean"
PAIRS = "doc_a long, doc_b long, jaccard double"


def _joiner(t_min: float, as_pairs: bool):
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        comp, bi, bj, blk, sizes, sig, ids, rows_, prefix = (t[c].to_numpy() for c in ("root", "bi", "bj", "blk", "size", "sig", "id", "n", "prefix"))
        gr, rk = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t["grams"], t["ranks"]))
        g_all, d_all, offs = gr.flatten().to_numpy(), rk.flatten().to_numpy(), gr.offsets.to_numpy() - gr.offsets[0].as_py()
        order = np.lexsort((sig, blk, bj, bi, comp))
        key = np.stack([comp[order], bi[order], bj[order]], axis=1)
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        out: list[tuple] = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)]):
            rows = order[a:b]
            many = (offs[rows + 1] - offs[rows]).astype(np.int64)
            at = spread(offs[rows].astype(np.int64), many)
            grams, one, inv = np.unique(g_all[at], return_index=True, return_inverse=True)
            rank = np.empty(len(grams), np.int64)  # global order: rarest first
            rank[np.lexsort((grams, d_all[at][one]))] = np.arange(len(grams))
            flat, ends = rank[inv], np.cumsum(many)
            sets = [(np.sort(flat[e - m : e]), int(sizes[i]), int(prefix[i])) for i, m, e in zip(rows, many, ends)]
            n = len(rows) if bi[rows[0]] == bj[rows[0]] else int((blk[rows] == bi[rows[0]]).sum())
            if not 0 < n or n == len(rows) and bi[rows[0]] != bj[rows[0]]:
                continue
            i, j, jac = join_sets(sets[:n], None if n == len(rows) else sets[n:], t_min)
            if n < len(rows):
                j = j + n
            if as_pairs:
                x, y = ids[rows[i]], ids[rows[j]]
                out.append((np.minimum(x, y), np.maximum(x, y), np.round(jac, 6)))
                continue
            got = np.union1d(i, j)
            links = np.bincount(i, rows_[rows[j]], len(rows)) + np.bincount(j, rows_[rows[i]], len(rows))
            by = np.lexsort((sig[rows], ids[rows]))  # the place of each set by (id, set)
            place = np.empty(len(rows), np.int64)
            place[by] = np.arange(len(rows))
            root = by[linked(place[i], place[j], len(rows))[place]]
            out.append((sig[rows[got]], sig[rows[root[got]]], ids[rows[root[got]]], links[got].astype(np.int64), np.full(len(got), bool(t["blocks"][int(rows[0])].as_py() > 1))))
        release()
        schema = PAIRS if as_pairs else LINKS
        kinds = {"long": np.int64, "double": float, "boolean": bool}
        names = [x.split() for x in schema.split(", ")]
        return pa.table([pa.array(np.concatenate([np.zeros(0, kinds[k]), *(o[i] for o in out)])) for i, (_, k) in enumerate(names)], names=[c for c, _ in names])

    return run


def sets(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(rows of SETS for all documents with an id, cut; number of hash ranges)."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    ranges = shards(base, RANGE_BYTES)
    counted = base.mapInArrow(_sender(n, ranges), SENT).groupBy("k").applyInArrow(_counter(_width(ranges)), SENT)
    return cut(counted.groupBy("flush").applyInArrow(_assembler(threshold, _width(ranges)), SETS)), ranges


def _tasks(every: DataFrame, threshold: float, block: int) -> DataFrame:
    """The sets that can have partners, a copy for each pair of blocks of their component that they are in."""
    live = every.where("prefix > 0")
    post = live.select(F.explode(F.slice("grams", 1, F.col("prefix"))).alias("g"), F.col("sig"))
    least = post.groupBy("g").agg(F.min("sig").alias("b"), F.count("*").alias("n")).where("n > 1").select("g", "b")
    edges = cut(post.join(least, "g").where("sig <> b").select(F.col("sig").alias("a"), "b").distinct())
    at = live.join(components(edges).withColumnRenamed("node", "sig"), "sig")
    # sizes of two bands apart differ by more than the threshold allows
    base = max(math.log(1 / threshold), 1e-6) * (1 + 1e-9)
    at = cut(at.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / base).cast("int")))
    many = at.groupBy("root").agg(F.count("*").alias("c"), F.sum(F.size("grams")).alias("g")).where(f"c > {block} OR g > {BLOCK_GRAMS}").select("root")
    bands = at.join(many, "root", "left_semi").groupBy("root", "band").agg(F.ceil(F.greatest(F.count("*") / block, F.sum(F.size("grams")) / BLOCK_GRAMS)).cast("int").alias("b"))
    by = bands.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("band", "b"))).alias("bands"), F.sum("b").alias("blocks"))
    at = at.join(small(cut(by), 256), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # blocks are numbered band by band; a set meets those of its own band and of both beside it
    start = F.expr("aggregate(bands, 0, (n, x) -> n + if(x.band < band, x.b, 0))")
    size = F.expr("aggregate(bands, 0, (n, x) -> n + if(x.band = band, x.b, 0))")
    blk = F.when(F.col("blocks") > 1, start + F.pmod(F.xxhash64("sig"), size)).otherwise(0).cast("int")
    others = F.expr("flatten(transform(bands, (x, i) -> if(abs(x.band - band) <= 1, sequence(aggregate(slice(bands, 1, i), 0, (n, y) -> n + y.b), aggregate(slice(bands, 1, i), 0, (n, y) -> n + y.b) + x.b - 1), cast(array() AS array<int>))))")
    at = at.withColumn("blk", blk).withColumn("o", F.explode(F.when(F.col("blocks") > 1, others).otherwise(F.array(F.lit(0)))))
    return at.withColumn("bi", F.least("blk", "o")).withColumn("bj", F.greatest("blk", "o")).drop("bands", "band", "o")


def _joined(every: DataFrame, ranges: int, threshold: float, block: int, as_pairs: bool) -> DataFrame:
    tasks = _tasks(every, threshold, block).withColumn("bin", F.pmod(F.xxhash64("root", "bi", "bj"), F.lit(ranges * 8)))
    return tasks.groupBy("bin").applyInArrow(_joiner(threshold, as_pairs), PAIRS if as_pairs else LINKS)


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, jaccard) of all pairs of different sets with a Jaccard similarity of at least threshold, each by its least id."""
    every, ranges = sets(docs, threshold, n, id_col, text_col)
    return _joined(every, ranges, threshold, block, True)


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links) of every document: the least id of its group, and how many others reach the threshold with it."""
    every, ranges = sets(docs, threshold, n, id_col, text_col)
    got = cut(_joined(every, ranges, threshold, block, False))
    by = got.groupBy("sig").agg(F.min("to_id").alias("class_id"), F.sum("links").alias("links"))
    apart = cut(got.where("wide AND sig <> to").select(F.col("sig").alias("a"), F.col("to").alias("b")).distinct())
    if apart.limit(1).count():  # components of several tasks
        whole = components(apart).withColumnRenamed("node", "sig")
        ids = got.where("wide").select("sig", "to_id").join(whole, "sig").groupBy("root").agg(F.min("to_id").alias("least"))
        by = by.join(whole.join(ids, "root").select("sig", "least"), "sig", "left").select("sig", F.coalesce("least", "class_id").alias("class_id"), "links")
    own = every.where("n > 1 OR prefix > 0").select("sig", "id", "n")
    known = own.join(by, "sig", "left").select("sig", F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).where("n_links > 0")
    out = every.select("id", "sig").join(small(cut(known), 32), "sig", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    null = F.lit(None).cast("long")
    return out.unionByName(docs.where(F.col(id_col).cast("long").isNull()).select(null.alias("doc_id"), null.alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """docs without those that have a smaller id in their group of near duplicates; a row without id is kept."""
    lost = "__lost"
    while lost in docs.columns:
        lost = "_" + lost
    drop = small(cut(classes(docs, threshold, n).where("doc_id <> class_id").select(F.col("doc_id").alias(lost)).distinct()))
    return docs.join(drop, docs["doc_id"].cast("long") == drop[lost], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
