"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text falls into units that no piece crosses: a run of spaces with what
follows up to the next space. The distinct units of a batch that the worker hasn't met are concatenated and
indexed by a suffix array (prefix doubling up to the longest piece); every piece
of the vocabulary is binary-searched in it, all pieces at once, by the ranks that
doubling gave to its halves, which gives the
ranges of its occurrences. The edges so found are sorted by the place where they
end and relaxed from left to right: an edge is taken if its piece is stable
under merging next to the last piece of what precedes it, which makes the path
the one that byte pair encoding gives. Code points without a piece become byte
pieces. Decoding gathers the pieces' bytes.

Defined results: the mark of a space in a text is a space, as in the model's own
encoder; a null text has null ids and decodes to null; an empty text has
no ids; a null id is carried along; rows that repeat are encoded each; a very long
text is encoded whole. Of edges that tie the stable one is taken, and only one is.
An empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import read, release, spread

MODEL = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/piece_bpe_32k.model"
MARK = "▁"
#: Code points of text that are indexed together.
BATCH_CHARS = 4_000_000
#: Units whose ids a worker keeps; beyond, it starts anew, which costs time only.
KEPT_UNITS = 300_000
#: Pairs of pieces whose stability a worker keeps; beyond, likewise.
KEPT_PAIRS = 1 << 21


class Pairs:
    """A hash table from pairs of pieces to whether they are stable; open addresses, all keys of a call at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the keys' values, the places of keys that aren't there)."""
        slot = self.slot(keys)
        have = self.keys[slot]
        out, lost = self.value[slot], []
        open_ = np.flatnonzero(have != keys)
        while open_.size:
            none = have[open_] < 0
            lost.append(open_[none])
            open_ = open_[~none]
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            have[open_] = self.keys[slot[open_]]
            hit = have[open_] == keys[open_]
            out[open_[hit]] = self.value[slot[open_[hit]]]
            open_ = open_[~hit]
        return out, np.concatenate(lost) if lost else open_

    def add(self, keys: np.ndarray, value: np.ndarray) -> None:
        """Distinct keys that aren't there."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            old = self.keys >= 0
            keys, value = np.concatenate([self.keys[old], keys]), np.concatenate([self.value[old], value])
            self.__init__(max(self.bits, (len(keys) * 4).bit_length()))
        self.n += len(keys)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one place, one gets it
            mine = self.keys[slot] == keys
            self.value[slot[mine]] = value[mine]
            keys, value, slot = keys[~mine], value[~mine], (slot[~mine] + 1) & (len(self.keys) - 1)


class Codec:
    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.pieces = {i: sp.id_to_piece(i).replace(MARK, " ") for i in plain}
        if any(" " in p.lstrip(" ") for p in self.pieces.values()):
            raise ValueError("a piece crosses a word boundary")
        self.rank = {p: -sp.get_score(i) for i, p in self.pieces.items()}
        self.ids = {p: i for i, p in self.pieces.items()}
        # a piece that merging never makes from its own text can't be in an encoding
        ok = [i for i in plain if len(self.pieces[i]) == 1 or self.merge(self.pieces[i]) == [self.pieces[i]]]
        ok.sort(key=lambda i: -len(self.pieces[i]))  # longer ones first, as edges are wanted
        self.usable = np.array(ok, np.int64)
        self.longest = max(len(self.pieces[i]) for i in ok)
        self.codes = np.zeros((len(ok), self.longest), np.int64)
        self.width = np.array([len(self.pieces[i]) for i in ok], np.int64)
        for r, i in enumerate(ok):
            self.codes[r, : self.width[r]] = [ord(c) for c in self.pieces[i]]
        text = [b""] * sp.get_piece_size()
        for i, p in self.pieces.items():
            text[i] = p.encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            text[i] = bytes([b])
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.size = np.array([len(x) for x in text], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.numbers: dict[str, int] = {}  # units encoded so far, with their ids one after the other
        self.flat, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.pairs = Pairs()

    def merge(self, s: str) -> list[str]:
        """Byte pair encoding: the best-scored adjacent pair first, the leftmost of equals."""
        parts, rank = list(s), self.rank.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """For pairs of piece ids (-2: a code point without a piece), whether merging leaves both as they are."""
        out = np.ones(len(piece), bool)
        real = np.flatnonzero((before >= 0) & (piece >= 0))
        keys = before[real] << 32 | piece[real]
        known, lost = self.pairs.find(keys)
        if len(lost):
            new, inv = np.unique(keys[lost], return_inverse=True)
            p, ok = self.pieces, []
            for k in new.tolist():
                a, b = p[k >> 32], p[k & 0xFFFFFFFF]
                ok.append(self.merge(a + b) == [a, b])
            self.pairs.add(new, np.array(ok, bool))
            known[lost] = np.array(ok, bool)[inv]
        out[real] = known
        return out

    def suffixes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, list[tuple[np.ndarray, int]]]:
        """Suffixes by their first signs, `longest` at least; as many signs as 62 bits hold are sorted at once.

        (suffixes in order, where those of each rank begin, signs at once, and for each doubling the sorted windows, a
        number each, with the number of ranks of a half). After the text come gaps, signs 0.
        """
        bits = int(text.max()).bit_length()
        k = 1 << (62 // bits).bit_length() - 1
        text = np.concatenate([text, np.zeros(2 * max(k, self.longest), text.dtype)])
        key, n, at_once, levels, ranks = text.astype(np.int64), len(text), k, [], 1 << bits
        for w in range(k.bit_length() - 1):  # windows of twice as many signs
            key[: n - (1 << w)] = key[: n - (1 << w)] << (bits << w) | key[1 << w :]
        while True:
            order = np.argsort(key)
            s = key[order]
            first = np.ones(n, bool)
            first[1:] = s[1:] != s[:-1]
            levels.append((s[first], ranks))
            if k >= self.longest:
                return order, np.append(np.flatnonzero(first), n), at_once, levels
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(first) - 1
            ranks = len(levels[-1][0])
            key = rank * ranks
            key[: n - k] += rank[k:]
            k *= 2

    def edges(self, text: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, row of `usable`) of every occurrence of every piece in a text of sign numbers."""
        # pieces in the batch's numbers; with a sign that isn't in it, a piece can't occur
        num = np.searchsorted(signs, self.codes)
        num = np.where(signs[np.minimum(num, len(signs) - 1)] == self.codes, num + 1, -1)
        inside = np.arange(self.longest) < self.width[:, None]
        rows = np.flatnonzero(((num > 0) | ~inside).all(axis=1))
        sa, begin, k, levels = self.suffixes(text)
        width, full = self.width[rows], k << len(levels) - 1
        part = np.zeros((len(rows), full), np.int64)
        part[:, : self.longest] = np.where(inside, num, 0)[rows]
        part = part.reshape(len(rows), -1, k)
        # windows that a piece's part may have, from lo to below hi; past the piece's end, any
        bits = int(levels[0][1]).bit_length() - 1
        lo = (part << np.arange(k - 1, -1, -1) * bits).sum(axis=2)
        hi = lo + (1 << bits * (k - np.clip(width[:, None] - np.arange(0, full, k), 0, k)))
        for level, (keys, ranks) in enumerate(levels):
            if level:
                lo, hi = lo[:, ::2] * ranks + lo[:, 1::2], (hi[:, ::2] - 1) * ranks + hi[:, 1::2]
            r, c = np.nonzero(np.arange(0, full, full // lo.shape[1]) < width[:, None])
            low, high = np.zeros(lo.shape, np.int64), np.full(lo.shape, len(keys))
            low[r, c] = np.searchsorted(keys, lo[r, c])
            high[r, c] = np.maximum(low[r, c], np.searchsorted(keys, hi[r, c]))
            lo, hi = low, high
        a = begin[lo[:, 0]]
        many = begin[hi[:, 0]] - a
        return sa[spread(a, many)], np.repeat(rows, many)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, number of ids of each)."""
        if not units:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        cp = np.frombuffer("\0".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(u) for u in units], np.int64)
        begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        gap = np.zeros(len(cp), bool)
        gap[(begin[1:] - 1)] = True
        signs = np.unique(cp[~gap])
        text = np.searchsorted(signs, cp) + 1
        text[gap] = 0
        start, row = self.edges(text, signs)
        width, piece = self.width[row], self.usable[row]
        single = np.zeros(len(cp), bool)
        single[start[width == 1]] = True
        bare = np.flatnonzero(~single & ~gap)  # code points without a piece
        start, width, piece = np.concatenate([start, bare]), np.concatenate([width, np.ones(len(bare), np.int64)]), np.concatenate([piece, np.full(len(bare), -2)])
        owner = np.repeat(np.arange(len(units)), size + 1)[start]
        end = start + width
        step = end - begin[owner]
        order = np.argsort(step.astype(np.uint16) if size.max() < 1 << 16 else step, kind="stable")  # by place in the unit; of those that end at one, longer ones first
        start, piece, end, step, first = start[order], piece[order], end[order], step[order], (start == begin[owner])[order]
        last, back = np.full(len(cp) + 1, -1, np.int64), np.full(len(cp) + 1, -1, np.int64)
        cuts = np.searchsorted(step, np.arange(1, int(size.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            ok = first[a:b] | self.stable(np.where(first[a:b], -2, last[start[a:b]]), piece[a:b])
            i = a + np.flatnonzero(ok)
            i = i[::-1]  # of several, which doesn't happen with a consistent vocabulary, the longest stays
            last[end[i]], back[end[i]] = piece[i], start[i]
        # walk back from the end of every unit at once
        at, who = begin + size, np.arange(len(units))
        got_id, got_unit, got_at = [], [], []
        while len(at):
            got_id.append(last[at])
            got_at.append(at)
            got_unit.append(who)
            src = back[at]
            more = src > begin[who]
            at, who = src[more], who[more]
        many = np.bincount(np.concatenate(got_unit), minlength=len(units))
        upto = np.cumsum(many)
        ids, place = np.empty(int(upto[-1]), np.int64), np.empty(int(upto[-1]), np.int64)
        for k, (x, u, p) in enumerate(zip(got_id, got_unit, got_at)):
            ids[upto[u] - 1 - k], place[upto[u] - 1 - k] = x, p - 1
        bare = np.flatnonzero(ids == -2)
        if len(bare):  # code points without a piece, as the pieces of their bytes
            code = cp[place[bare]]
            wide = np.ones(len(ids), np.int64)
            wide[bare] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            raw = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            ids, unit = np.repeat(ids, wide), np.repeat(np.repeat(np.arange(len(units)), many), wide)
            ids[ids == -2] = self.byte_ids[np.frombuffer(raw, np.uint8)]
            many = np.bincount(unit, minlength=len(units))
        return ids.astype(np.int32), many

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        return self.encode_array(pa.array(texts, pa.large_string()))

    def units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units of texts without nulls, the number of each unit in turn, units of each text)."""
        words = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")  # a space precedes each, the first one too
        per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ends = np.cumsum(per)
        last = np.zeros(len(code), bool)
        last[ends - 1] = True
        void = code == names.index("") if "" in names else np.zeros(len(code), bool)
        if not void.any():
            return [" " + x for x in names], code, per
        # an empty word is one more space before what follows; at a text's end spaces are a unit, and an empty text has none
        place, doc = np.arange(len(code)), np.repeat(np.arange(len(per)), per)
        begin = (ends - per)[doc]
        met = np.concatenate([[-1], np.maximum.accumulate(np.where(void, -1, place))[:-1]])
        spaces = place - np.maximum(met, begin - 1)
        kept = np.flatnonzero(~void | last & ~(void & (per == 1)[doc]))
        spaces, code = spaces[kept], code[kept]
        more = np.flatnonzero(spaces > 1)
        key, idx = np.unique(spaces[more] * len(names) + code[more], return_inverse=True)
        code[more] = len(names) + idx
        return [" " + x for x in names] + [" " * (x // len(names)) + names[x % len(names)] for x in key.tolist()], code, np.bincount(doc[kept], minlength=len(per))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode of an array without nulls."""
        if len(texts) == 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(self.numbers) > KEPT_UNITS:
            self.numbers, self.flat, self.many = {}, np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.pairs.n > KEPT_PAIRS:
            self.pairs = Pairs()
        numbers, old = self.numbers, len(self.numbers)
        names, idx, per = self.units(texts)
        idx = np.array([numbers.setdefault(u, len(numbers)) for u in names], np.int64)[idx]
        new, n = self.encode_units(list(itertools.islice(numbers, old, None)))
        self.flat, self.many = np.concatenate([self.flat, new]), np.concatenate([self.many, n])
        flat, many = self.flat, self.many
        at = np.cumsum(many) - many
        ids = flat[spread(at[idx], many[idx])]
        ends = np.concatenate([[0], np.cumsum(many[idx])])
        upto = np.cumsum(per)
        return ids, ends[upto] - ends[upto - per]

    def decode(self, ids: np.ndarray, many: np.ndarray) -> list[str]:
        raw, ends = self.decode_bytes(ids, many)
        raw, ends = raw.tobytes(), ends.tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]

    def decode_bytes(self, ids: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts in a row, where they begin and, at last, end); the first space of each is left out."""
        n = self.size[ids]
        raw = self.blob[spread(self.at[ids], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(many)])]
        begin = np.flatnonzero(ends[1:] > ends[:-1])
        begin = begin[raw[ends[begin]] == 32]
        less = np.zeros(len(ends), np.int64)
        less[begin + 1] = 1
        return np.delete(raw, ends[begin]), ends - np.cumsum(less)


_codecs: dict[str, Codec] = {}


def codec(model: str = MODEL) -> Codec:
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_ids, ids, round_trip) of every row; round_trip: the ids decode to exactly the text."""

    def run(batches):
        c = codec(model)
        for big in batches:
            texts, docs_ids = big["text"].cast(pa.large_string()), big["doc_id"]
            chars = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            a = 0
            while a < len(texts):
                b, n = a, 0
                while b < len(texts) and (b == a or n < BATCH_CHARS) and b - a < 4096:
                    n += chars[b]
                    b += 1
                part = texts[a:b]
                null = part.is_null().to_numpy(zero_copy_only=False)
                ids, many = c.encode_array(pc.fill_null(part, ""))
                raw, ends = c.decode_bytes(ids, many)
                offs = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offs, pa.array(ids, pa.int32()), mask=pa.array(null))
                back = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
                same = pc.equal(part.cast(pa.large_binary()), back)
                release()
                yield pa.RecordBatch.from_arrays([docs_ids[a:b], pa.array(many.astype(np.int64), mask=null), lists, same], names=["doc_id", "n_ids", "ids", "round_trip"])
                a = b

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids."""

    def run(batches):
        c = codec(model)
        for b in batches:
            lists = b["ids"].to_pylist()
            many = np.array([len(x or ()) for x in lists], np.int64)
            texts = c.decode(np.array([i for x in lists for i in x or ()], np.int64), many)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([None if x is None else t for x, t in zip(lists, texts)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
