"""Exact token counts of every prefix by dynamic programming.

For a byte-level BPE vocabulary, the encoding of a prefix ends in the one token
whose pairing with the last token of what precedes it is stable under merging.
So the count at each place is the count before that token plus one, in one pass
over a piece; pieces are those of the pre-tokenizer. A stretch of white space
with the word after it always splits alike, so its table is made once a worker.

A document's table has one signed byte for each code point: the change of the
count. Its running sum is the exact count of every prefix, which answers, with
no further encoding, how many tokens a prefix has and where to cut for a budget.

Defined results: a null text has null counts and table; an empty text has 0
tokens and an empty table; a null id is carried along; strings of special tokens
are ordinary text. A cut is the longest prefix with no more tokens than the
budget; null where nothing has to be cut. Of places with equal counts the last is
the cut. Rows that repeat have a row each; a very long text has a table as long; an
empty table gives no rows; other columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import read, release

VOCABULARY = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BUDGETS = (256, 1024, 4096)
#: Tables of chunks that a worker keeps; a full cache starts anew, which costs time only.
CACHED = 300_000
PARTS = {"'ll", "'ve", "'re"}
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


class PrefixCounter(dict):
    """chunk -> bytes: the change of the token count at each code point."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import ahocorasick
        import regex

        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.ends = ahocorasick.Automaton()  # all tokens that end at a place, longest first
        for t, i in self.ranks.items():
            self.ends.add_word(t.decode("latin-1"), (len(t), i))
        self.ends.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[bytes]:
        """Byte pair encoding: the pair of least rank first, the leftmost of equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
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

    def stable(self, a: int, b: int) -> bool:
        """Whether merging leaves token b after token a as they are."""
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        x, y = self.tokens[a], self.tokens[b]
        got = self.pairs[a << 32 | b] = self.merge(x + y) == [x, y]
        return got

    def piece(self, b: str) -> list[int]:
        """The token count of each prefix of a piece, from 0 on; the piece's bytes as Latin-1."""
        last, count, pairs = [-1] * (len(b) + 1), [0] * (len(b) + 1), self.pairs.get
        for end, (size, token) in self.ends.iter(b):
            end += 1
            if last[end] < 0:
                j = end - size
                if j:
                    before = last[j]
                    ok = pairs(before << 32 | token)
                    if ok is None:
                        ok = self.stable(before, token)
                    if not ok:
                        continue
                last[end], count[end] = token, count[j] + 1
        if -1 in last[1:]:
            raise ValueError("the vocabulary lacks a byte")
        return count

    def text(self, t: str) -> list[int]:
        """Counts at the code points of a text that splits into pieces as it stands, the last one perhaps not whole."""
        out, base = [], 0
        for p in self.split(t):
            if p in PARTS:  # of a contraction, a part isn't one
                whole = [1, len(self.merge(b"'")) + len(self.merge(p[1].encode())), len(self.merge(p.encode()))]
                out += [base + x for x in whole]
                base = out[-1]
                continue
            if p.isascii():
                out += [base + x for x in self.piece(p)[1:]] if base else self.piece(p)[1:]
            else:
                count, at = self.piece(p.encode().decode("latin-1")), 0
                for c in p:
                    at += 1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4
                    out.append(base + count[at])
            base = out[-1]
        return out

    def __missing__(self, chunk: str) -> bytes:
        full = self.text(chunk)
        if chunk[:2].isspace() and len(chunk) > 1:  # white space that the prefix ends in is one piece; before a word its last sign is apart
            k = len(chunk) - len(chunk.lstrip(BLANKS))
            if 1 < k < len(chunk):
                full[:k] = self.text(chunk[:k])
        out = bytes([(y - x) & 255 for x, y in zip([0, *full], full)])
        if len(chunk) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = out
        return out

    def table(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))


_counters: dict[str, PrefixCounter] = {}


def counter(vocabulary: str = VOCABULARY) -> PrefixCounter:
    if vocabulary not in _counters:
        _counters[vocabulary] = PrefixCounter(vocabulary)
    return _counters[vocabulary]


def counts(table: bytes) -> np.ndarray:
    """The token count of each prefix of 1, 2, ... code points."""
    return np.cumsum(np.frombuffer(table, np.int8), dtype=np.int32)


def count_at(table: bytes, chars: int) -> int:
    """Tokens of the prefix of so many code points."""
    return int(np.frombuffer(table, np.int8)[:chars].sum(dtype=np.int64))


def cut_at(table: bytes, budget: int) -> int:
    """Code points of the longest prefix of at most `budget` tokens."""
    at = np.flatnonzero(counts(table) <= budget)
    return int(at[-1]) + 1 if len(at) else 0


def prefix_counts(docs: DataFrame, budgets: tuple[int, ...] = BUDGETS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_chars, n_tokens, cut_<budget>..., prefix_deltas) of every row."""
    names = ["doc_id", "n_chars", "n_tokens", *(f"cut_{b}" for b in budgets), "prefix_deltas"]

    def run(batches):
        pc = counter(vocabulary)
        for big in batches:
            for a in range(0, big.num_rows, 1000):
                b = big.slice(a, 1000)
                tables, n, cuts = [], [], [[] for _ in budgets]
                for t in b["text"].to_pylist():
                    if t is None:
                        tables.append(None)
                        n.append(None)
                        for c in cuts:
                            c.append(None)
                        continue
                    x = pc.table(t)
                    tables.append(x)
                    c = counts(x)
                    n.append(int(c[-1]) if len(c) else 0)
                    for out, most in zip(cuts, budgets):
                        out.append(int(np.flatnonzero(c <= most)[-1]) + 1 if n[-1] > most else None)
                chars = [None if x is None else len(x) for x in tables]
                cols = [b["doc_id"], *(pa.array(x, pa.int64()) for x in (chars, n, *cuts)), pa.array(tables, pa.binary())]
                release()
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_chars long, n_tokens long, " + "".join(f"cut_{b} long, " for b in budgets) + "prefix_deltas binary"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_counts(read(spark, sf_dir, "documents"))
