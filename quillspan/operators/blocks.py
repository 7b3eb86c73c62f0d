"""The parser: one document to typed records with byte spans.

Block structure is an automaton over lines whose branches are tried in a fixed
order; inline constructs are scanned a line at a time. A document is parsed
alone, so parsing is a narrow map over rows; they are shuffled for it only where they lie in too few tasks.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import patterns as P
from quillspan.operators import inline as I
from quillspan.operators.spread import spread

COLUMNS = {
    "doc_id": "bigint", "path": "string", "seq": "int", "kind": "string", "start": "bigint", "end": "bigint", "line": "int", "end_line": "int", "protected": "boolean",
    "depth": "int", "parent": "bigint", "level": "int", "style": "string", "text": "string", "plain": "string", "form": "string", "html_kind": "string", "unterminated": "boolean",
    "label": "string", "destination": "string", "dest_start": "bigint", "dest_end": "bigint", "key": "string", "key_start": "bigint", "key_end": "bigint", "mode": "string",
    "text_start": "bigint", "text_end": "bigint",
}
SCHEMA = ", ".join(f"`{n}` {t}" for n, t in COLUMNS.items())
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
TAB = 4
PAGE = re.compile(r"^[ \t]*p\. \d")
_c = {n: re.compile(getattr(P, n)) for n in ("BLANK", "ATX", "BULLET", "DECIMAL", "FANCY", "EXAMPLE", "FENCE", "FENCE_OPEN", "FRONT", "FRONT_END", "TABLE_ROW", "GRID_BORDER", "GRID_ROW", "DASHES_SPACED", "DASHES_FULL", "PIPE_DELIMITER", "QUOTE", "SETEXT", "DEFINITION", "TITLE_LINE", "BREAK")}
_HTML = [(k, re.compile(v), re.compile(P.HTML_ENDS[k])) for k, v in P.HTML_KINDS.items()]
_ROMAN = re.compile(f"^{P.ROMAN_BODY}$", re.I)


def is_blank(s: str) -> bool:
    return not s.strip(" \t\n\x0b\f\r")


def columns(s: str, upto: int | None = None, col: int = 0) -> int:
    """Display column after the leading blanks, or after s[:upto] where all of it are blanks."""
    if s[:1] not in (" ", "\t"):
        return col
    for ch in s[:upto] if upto is not None else s:
        if ch == "\t":
            col += TAB - col % TAB
        elif ch == " ":
            col += 1
        else:
            break
    return col


def roman_value(s: str) -> int:
    """The value of a loosely written roman numeral, else 0."""
    if not s or not _ROMAN.match(s):
        return 0
    worth = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))
    v = [worth[c] for c in s.lower()]
    return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))


#: First characters that a pattern of a line can begin with after its blanks; the pattern is asked only of such lines.
_BULLETS, _FENCES, _BREAKS, _DASHES, _RULES = frozenset("-*+"), frozenset("`~"), frozenset("-*_"), frozenset("+-"), frozenset("=-")
_UNPLAIN = frozenset("`~>|-*_+#<")
_MARKERS = dict.fromkeys("0123456789#", (("decimal", "DECIMAL"),)) | dict.fromkeys(string.ascii_letters, (("fancy", "FANCY"),)) | {"@": (("example", "EXAMPLE"),), "(": (("decimal", "DECIMAL"), ("example", "EXAMPLE"), ("fancy", "FANCY"))}


#: Values that one letter spells, and the greatest that is taken for a place in a list.
ONE_LETTER, LIST_NUMERAL = (1, 5, 10, 50, 100, 500, 1000), 30


def marker(s: str, fancy: bool = True) -> tuple[str, int] | None:
    """(style, characters of indent and marker) of a list item's line."""
    c = s.lstrip(" \t")[:1]
    if c in _BULLETS:
        return ("bullet", len(s) - len(s.lstrip(" \t")) + 1) if _c["BULLET"].match(s) else None
    for kind, name in _MARKERS.get(c, ()):
        m = _c[name].match(s)
        if not m or (kind == "fancy" and not fancy):
            continue
        body = s[: m.end()].strip(" \t")
        shape = "()" if body.startswith("(") else body[-1]
        end = len(s[: m.end()].rstrip(" \t"))
        if kind == "fancy":
            word = body.strip("().")
            if PAGE.match(s):
                return None
            if len(word) > 1 and not roman_value(word):
                return None
            if word.isupper() and shape == "." and (len(word) == 1 or roman_value(word) in ONE_LETTER):
                rest = s[end:]
                if rest and columns(rest, len(rest) - len(rest.lstrip(" \t")), 0) < 2:
                    return None
            kind = ("roman" if roman_value(word) else "alpha") + ("-upper" if word.isupper() else "-lower")
        return f"{kind}{shape}", end
    return None


def quotes(s: str) -> bool:
    """Whether a line, or the body of an item, begins a quote."""
    return bool(_c["QUOTE"].match(s.lstrip(" \t") if s[:4].strip() else s))


def doubtful(s: str) -> bool:
    """Whether a line that opens a block may not be the list item that it reads as: an initial, a labelled example, a word that is a numeral."""
    if re.match(P.INITIAL, s):
        return True
    m = marker(s)
    if not m or m[0] == "bullet":
        return False
    body = s[: m[1]].strip(" \t")
    if m[0].startswith("example"):
        return len(body.strip("(@).")) > 0
    word = body[:-1]
    return len(word) > 1 and word.islower() and word.isalpha() and roman_value(word) > LIST_NUMERAL


def content_column(s: str, m: tuple[str, int]) -> int:
    indent = len(s) - len(s.lstrip(" \t"))
    col = columns(s, indent) + m[1] - indent
    rest = s[m[1] :]
    blanks = len(rest) - len(rest.lstrip(" \t"))
    return col + 1 if not rest.strip(" \t") and not blanks else columns(rest, blanks, col)


class Doc:
    def __init__(self, text: str, inlines: bool = True, items: bool = True):
        self.inlines, self.items = inlines, items
        self.rows: list[dict] = []
        bom = 3 if text.startswith("﻿") else 0
        self.size = len(text.encode()) if not text.isascii() else len(text)
        parts = text[1:].split("\n") if bom else text.split("\n")
        if parts and parts[-1] == "":
            parts.pop()
        self.lines, self.off, self.bytes = [], [], []
        at = bom
        for p in parts:
            s = p.rstrip("\r")
            n = len(s) if s.isascii() else len(s.encode())
            self.lines.append(s)
            self.off.append(at)
            self.bytes.append(n)
            at += n + len(p) - len(s) + 1
        self.first = [s.lstrip(" \t")[:1] for s in self.lines]

    # spans
    def byte(self, line: int, ch: int) -> int:
        s = self.lines[line]
        return self.off[line] + (ch if s.isascii() else len(s[:ch].encode()))

    def end(self, line: int) -> int:
        return self.off[line] + self.bytes[line]

    def add(self, kind: str, a: int, b: int, protected: bool = False, **more) -> dict:
        row = {"kind": kind, "start": self.off[a], "end": self.end(b), "line": a + 1, "end_line": b + 1, "protected": protected, "depth": 0, **more}
        self.rows.append(row)
        return row

    def scan(self, line: int, depth: int, parent: int, block_start: bool, skip: int = 0) -> None:
        if not self.inlines:
            return
        s = self.lines[line][skip:] if skip else self.lines[line]
        found = I.scan(s, block_start)
        if not found:
            return
        base = self.off[line] + skip if self.lines[line].isascii() else -1
        at = lambda c: None if c is None else base + c if base >= 0 else self.byte(line, c + skip)
        for x in found:
            row = {"kind": x.kind, "start": at(x.start), "end": at(x.end), "line": line + 1, "end_line": line + 1, "protected": x.kind in ("code_span", "raw_inline"), "depth": depth, "parent": parent}
            if x.kind == "citation":
                row.update(key=x.text, key_start=at(x.text_start), key_end=at(x.text_end), mode=x.mode)
            else:
                row.update(text=x.text, form=x.form, label=x.label, destination=x.destination, dest_start=at(x.dest_start), dest_end=at(x.dest_end), text_start=at(x.text_start), text_end=at(x.text_end))
            self.rows.append(row)

    def scan_lines(self, a: int, b: int) -> None:
        for k in range(a, b + 1):
            self.scan(k, 1, self.off[a], k == a)

    # line tests
    def is_table_at(self, i: int) -> tuple[str, int] | None:
        """(form, last line) of a grid, simple or multiline table that begins here."""
        L, n = self.lines, len(self.lines)
        if self.first[i] not in _DASHES and (i + 1 == n or self.first[i + 1] != "-"):
            return None
        if _c["GRID_BORDER"].match(L[i]):
            j = i
            while j + 1 < n and (_c["GRID_BORDER"].match(L[j + 1]) or _c["GRID_ROW"].match(L[j + 1])):
                j += 1
            return ("grid", j) if j > i else None
        if not is_blank(L[i]) and i + 1 < n and _c["DASHES_SPACED"].match(L[i + 1]) and not _c["DASHES_FULL"].match(L[i]) and not _c["BREAK"].match(L[i]):
            j = i + 1
            while j + 1 < n and not is_blank(L[j + 1]):
                j += 1
            return ("simple", j) if j > i + 1 else None
        if _c["DASHES_FULL"].match(L[i]):
            j = i + 1
            while j < n and not is_blank(L[j]) and not _c["DASHES_SPACED"].match(L[j]):
                j += 1
            if j > i + 1 and j < n and _c["DASHES_SPACED"].match(L[j]):
                for k in range(j + 1, n):
                    if _c["DASHES_FULL"].match(L[k]):
                        return "multiline", k
        return None

    def html_at(self, i: int) -> tuple[str, re.Pattern] | None:
        s = self.lines[i]
        if self.first[i] != "<":
            return None
        return next(((k, e) for k, o, e in _HTML if o.match(s)), None)

    def list_at(self, i: int, para_open: bool) -> tuple[str, int] | None:
        s = self.lines[i]
        if self.first[i] in _BREAKS and _c["BREAK"].match(s):
            return None
        m = marker(s, fancy=not para_open)
        return None if m and para_open and is_blank(s[m[1] :]) else m  # an empty item doesn't interrupt a paragraph

    def pipe_header(self, i: int) -> bool:
        s = self.lines[i]
        nxt = self.lines[i + 1] if i + 1 < len(self.lines) else ""
        return "|" in s and "|" in nxt and bool(_c["PIPE_DELIMITER"].match(nxt)) and not any(_c[n].match(s) for n in ("ATX", "QUOTE", "FENCE")) and not marker(s)

    def starts_block(self, i: int) -> bool:
        """What ends a paragraph at line i."""
        s, c = self.lines[i], self.first[i]
        if is_blank(s) or c == ">" or c == "|":
            return True
        opens = (c in _BREAKS and _c["BREAK"].match(s)) or (c == "#" and _c["ATX"].match(s)) or self.html_at(i) or (c in _FENCES and _c["FENCE_OPEN"].match(s))
        return bool(opens or self.list_at(i, True) or self.is_table_at(i))

    # the walk
    def parse(self) -> list[dict]:
        L, n = self.lines, len(self.lines)
        prev, para, col, blank, i = "", False, 0, True, 0
        if n and _c["FRONT"].match(L[0]):
            close = next((k for k in range(1, n) if _c["FRONT_END"].match(L[k])), None)
            if close is not None:
                self.add("frontmatter", 0, close, True)
                prev, blank, i = "TEXT", False, close + 1
        while i < n:
            s, c = L[i], self.first[i]
            indent = columns(s)
            open_ = not blank and para
            if c in _FENCES and (m := _c["FENCE_OPEN"].match(s)):
                run = m[1].lstrip(" \t")
                ch, size = run[0], len(run) - len(run.lstrip(run[0]))
                size = len(re.match(re.escape(ch) + "+", run)[0])
                end = next((k for k in range(i + 1, n) if self._closes(L[k], ch, size, indent)), None)
                last = n - 1 if end is None else end
                self.add("code_fence", i, last, True, unterminated=end is None)
                prev, para, col, blank, i = "FENCE", False, 0 if indent < col else col, False, last + 1
            elif t := self.is_table_at(i):
                self.add("table", i, t[1], True, form=t[0])
                self.scan_lines(i, t[1])
                prev, para, col, blank, i = "TABLE", False, 0 if indent < col else col, False, t[1] + 1
            elif h := self.html_at(i):
                after = s.index("<") + 1
                last = i if h[1].search(s, after) else next((k for k in range(i + 1, n) if h[1].search(L[k])), n - 1)
                self.add("raw_html", i, last, True, html_kind=h[0])
                prev, para, blank, i = "RAWHTML", False, False, last + 1
            elif is_blank(s):
                blank = True
                i += 1
            elif indent >= col + 4 and (blank or prev != "TEXT"):
                j = last = i
                while j + 1 < n and (is_blank(L[j + 1]) or columns(L[j + 1]) >= col + 4):
                    j += 1
                    last = last if is_blank(L[j]) else j
                self.add("code_indented", i, last, True)
                prev, para, blank, i = "INDENT", False, False, last + 1
            elif c == "|" or self.pipe_header(i):
                delim = i + 1 < n and "|" in L[i + 1] and bool(_c["PIPE_DELIMITER"].match(L[i + 1]))
                j = i
                while j + 1 < n and (("|" in L[j + 1] and not is_blank(L[j + 1])) if delim else _c["TABLE_ROW"].match(L[j + 1])):
                    j += 1
                if delim and j > i:
                    self.add("table", i, j, False, form="pipe")
                    self.scan_lines(i, j)
                else:
                    self.add("line_block", i, j)
                prev, para, col, blank, i = "TEXT", False, 0, False, j + 1
            elif c == "#" and _c["ATX"].match(s):
                self._heading(i, i, len(s.lstrip(" ")) - len(s.lstrip(" ").lstrip("#")), "atx", re.sub(r"(^|[ \t]+)#+[ \t]*$", "", s.lstrip(" ").lstrip("#")).strip(" \t"))
                prev, para, col, blank, i = "HEADING", False, 0, False, i + 1
            elif i + 1 < n and self.first[i + 1] in _RULES and _c["SETEXT"].match(L[i + 1]) and self._setext_text(i, open_):
                self._heading(i, i + 1, 1 if L[i + 1][0] == "=" else 2, "setext", s.strip(" \t"))
                prev, para, col, blank, i = "HEADING", False, 0, False, i + 2
            elif c in _BREAKS and _c["BREAK"].match(s):
                self.add("thematic_break", i, i, True)
                prev, para, col, blank, i = "TEXT", False, 0, False, i + 1
            elif c == "[" and (m := _c["DEFINITION"].match(s)):
                last = self._definition(i, m)
                prev, para, col, blank, i = "REFDEF", False, 0, False, last + 1
            elif mk := self.list_at(i, open_):
                last, col = self._list(i, mk)
                prev, para, blank, i = "BULLET", False, False, last + 1
            elif c == ">":
                j = i
                while j + 1 < n and self.first[j + 1] == ">":
                    j += 1
                self.add("block_quote", i, j)
                self.scan_lines(i, j)
                prev, para, col, blank, i = "TEXT", False, 0, False, j + 1
            else:
                j = i
                while j + 1 < n and not self.starts_block(j + 1):
                    j += 1
                self.add("paragraph", i, j)
                self.scan_lines(i, j)
                prev, para, col, blank, i = "TEXT", True, 0, False, j + 1
        return self._finish()

    def _closes(self, s: str, ch: str, size: int, indent: int) -> bool:
        t = s.strip(" \t")
        return len(t) >= size and not t.strip(ch) and t[:1] == ch and columns(s) <= indent + 3

    def _setext_text(self, i: int, open_: bool) -> bool:
        s = self.lines[i]
        return not (open_ or columns(s) >= 4 or any(_c[n].match(s) for n in ("ATX", "QUOTE", "BREAK", "DEFINITION", "TABLE_ROW", "FENCE_OPEN")) or marker(s) or is_blank(s))

    def _heading(self, a: int, b: int, level: int, style: str, text: str) -> None:
        self.add("heading", a, b, level=level, style=style, text=text, **({"plain": I.plain(text)} if self.items else {}))
        self.scan(a, 1, self.off[a], True)

    def _definition(self, i: int, m: re.Match) -> int:
        L, n, s = self.lines, len(self.lines), self.lines[i]
        if m[1].startswith("^"):
            last = j = i
            while j + 1 < n and (is_blank(L[j + 1]) or columns(L[j + 1]) >= 4):
                j += 1
                last = last if is_blank(L[j]) else j
            self.add("footnote_def", i, last, label=m[1][1:])
            self.scan(i, 1, self.off[i], False, m.end())
            for k in range(i + 1, last + 1):
                self.scan(k, 1, self.off[i], False)
            return last
        last = i
        if i + 1 < n and _c["TITLE_LINE"].match(L[i + 1]):
            last = i + 1
        a, b = I.bare_destination(s, m.end(), len(s))
        span = {"destination": s[a:b], "dest_start": self.byte(i, a), "dest_end": self.byte(i, b)} if b > a else {}
        self.add("reference_def", i, last, label=m[1], **span)
        return last

    def _list(self, i: int, mk: tuple[str, int]) -> tuple[int, int]:
        L, n = self.lines, len(self.lines)
        col, last, style = content_column(L[i], mk), i, mk[0]
        for j in range(i + 1, n):
            if is_blank(L[j]):
                continue
            m = self.list_at(j, False)
            if m and not _c["FENCE_OPEN"].match(L[j]):
                if m[0] != style:
                    break
                col, last = content_column(L[j], m), j
            elif L[j].startswith(P.CONTINUATION[1:]):
                col, last = min(col, columns(L[j])), j
            else:
                break
        self.add("list", i, last)
        if self.items:
            self._items(i, last)
        return last, col

    def _items(self, a: int, b: int) -> None:
        L, parent, i = self.lines, self.off[a], a
        while i <= b:
            m = marker(L[i])
            if not m:
                i += 1
                continue
            col, end = content_column(L[i], m), i
            for j in range(i + 1, b + 1):
                if marker(L[j]) or (not is_blank(L[j]) and columns(L[j]) < col):
                    break
                end = j
            run = None
            for j in range(i, end + 2):
                stop = j > end or is_blank(L[j])
                if not stop and run is None:
                    run = j
                if not stop or run is None:
                    continue
                if all(self._plain_line(k, col) or k == i for k in range(run, j)):
                    skip = m[1] + (len(L[i][m[1] :]) - len(L[i][m[1] :].lstrip(" \t"))) if run == i else 0
                    start, stop_at = self.byte(run, skip), self.end(j - 1)
                    if stop_at > start:
                        self.rows.append({"kind": "paragraph", "start": start, "end": stop_at, "line": run + 1, "end_line": j, "protected": False, "depth": 1, "parent": parent})
                        for k in range(run, j):
                            self.scan(k, 2, start, k == i, skip if k == i and run == i else 0)
                run = None
            i = end + 1

    def _plain_line(self, k: int, col: int) -> bool:
        s = self.lines[k]
        return columns(s) < col + 4 and (self.first[k] not in _UNPLAIN or not any(_c[n].match(s) for n in ("FENCE", "QUOTE", "TABLE_ROW", "BREAK", "GRID_BORDER", "DASHES_SPACED")) and not _c["ATX"].match(s.lstrip(" \t")) and not self.html_at(k))

    def _finish(self) -> list[dict]:
        """Gaps between blocks, and the numbers of records."""
        out, at, line = [], 0, 1
        for r in self.rows:
            if r["depth"] == 0:
                if r["start"] > at:
                    out.append(self._gap(at, r["start"], line, r["line"] - 1))
                at, line = r["end"], r["end_line"]
            out.append(r)
        if at < self.size:
            out.append(self._gap(at, self.size, line, max(line, len(self.lines))))
        for k, r in enumerate(out):
            r["seq"] = k + 1
        return out

    def _gap(self, a: int, b: int, line: int, end_line: int) -> dict:
        return {"kind": "gap", "start": a, "end": b, "line": line, "end_line": max(line, end_line), "protected": False, "depth": 0}


def parse(text: str, inlines: bool = True, items: bool = True) -> list[dict]:
    """Records of a text; without `items` none of what is inside of lists, and headings without their plain text."""
    return Doc(text, inlines, items).parse()


def records(docs: DataFrame, kinds: Iterable[str] | None = None, inlines: bool = True) -> DataFrame:
    """Records of docs (doc_id, path, text); `kinds` and `inlines` are pushed into the parser, and columns that aren't asked for never leave it."""
    only = None if kinds is None else frozenset(kinds)
    names = list(COLUMNS)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], ARROW[COLUMNS[n]]) for n in names], names=names)

    def run(batches):
        for b in batches:
            rows: list[dict] = []
            for doc_id, path, text in zip(b["doc_id"].to_pylist(), b["path"].to_pylist(), b["text"].to_pylist()):
                if text is None:
                    continue
                for r in parse(text, inlines):
                    if only is None or r["kind"] in only:
                        r["doc_id"], r["path"] = doc_id, path
                        rows.append(r)
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("path") if "path" in docs.columns else F.lit(None).cast("string")).alias("path"), "text")
    return spread(src).mapInArrow(run, SCHEMA)
