"""Repairs, editorial passes and lints: one function a document gives the new text and what was done where.

A pass sees what earlier passes left, and the whole is repeated until nothing
changes (at most PASSES times), inside the function, so that a rewrite is one
narrow Arrow map. Which pass may touch a line follows from the block it is in.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions import patterns as P
from quillspan.operators import blocks as B
from quillspan.operators import inline as I
from quillspan.operators.spread import spread

PASSES = 4
RULES = {
    "list.blank-before": "fix", "list.blank-after": "fix", "heading.atx-space": "fix", "list.marker-column": "fix", "list.bullet-style": "fix", "heading.emphasis": "fix", "emphasis.bold-colon": "fix",
    "punct.arrow-aside": "fix", "blockquote.space": "fix", "chicago.emdash-spacing": "fix", "chicago.ellipsis": "fix", "chicago.sentence-space": "fix", "chicago.space-before-punct": "fix",
    "chicago.space-after-punct": "fix", "chicago.quote-terminal-punct": "fix", "chicago.abbrev-comma": "fix", "chicago.etal-period": "fix", "footnote.ref-format": "fix", "footnote.def-format": "fix",
    "heading.canonical": "fix", "fence.canonical": "fix", "link.autolink-bare": "fix", "heading.scrivener-split": "fix", "whitespace.trailing": "fix", "chicago.serial-comma": "warning",
    "chicago.number-style": "warning", "unicode.non-nfc": "warning", "fence.unterminated": "warning", "list.marker-ambiguous": "warning",
}
#: What a rule does, in words for reports.
LABELS = {
    "list.blank-before": "blank line before a list", "list.blank-after": "blank line after a list", "heading.atx-space": "one space after the signs of a heading", "list.marker-column": "two columns after a capital marker",
    "list.bullet-style": "hyphens for bullets", "heading.emphasis": "no emphasis in a heading", "emphasis.bold-colon": "colon inside of bold", "punct.arrow-aside": "dash for an arrow between words",
    "blockquote.space": "space after a quote sign", "chicago.emdash-spacing": "spacing of dashes", "chicago.ellipsis": "one sign for an ellipsis", "chicago.sentence-space": "one space between sentences",
    "chicago.space-before-punct": "no space before punctuation", "chicago.space-after-punct": "space after punctuation", "chicago.quote-terminal-punct": "punctuation inside of quotes", "chicago.abbrev-comma": "comma after an abbreviation",
    "chicago.etal-period": "period after al", "footnote.ref-format": "form of a note's reference", "footnote.def-format": "form of a note", "heading.canonical": "no closing signs of a heading", "fence.canonical": "form of a fence",
    "link.autolink-bare": "brackets around an address", "heading.scrivener-split": "heading split over two lines", "whitespace.trailing": "blanks at the end of a line", "chicago.serial-comma": "comma before the last of a series",
    "chicago.number-style": "small number in figures", "unicode.non-nfc": "code points that aren't composed", "fence.unterminated": "fence without an end", "list.marker-ambiguous": "marker that may be an initial, a citation or a word",
}
REQUIRED = ("list.blank-before", "list.blank-after", "heading.atx-space", "list.marker-column")


@dataclass(frozen=True)
class Options:
    required: bool = True
    editorial: bool = False
    chicago_punct: bool = False
    chicago_punct2: bool = False
    chicago_abbrev: bool = False
    footnote: bool = False
    heading: bool = False
    fence: bool = False
    whitespace: bool = False
    safe_links: bool = False
    scrivener: bool = False
    nfc: bool = False
    wrap: int = 0
    spaced_emdash: bool = False
    arrow_aside: bool = True
    quote_punct: bool = True
    serial_comma: bool = False
    number_style: bool = False


CANONICAL = Options(editorial=True, chicago_punct=True, chicago_punct2=True, chicago_abbrev=True, footnote=True, heading=True, fence=True, whitespace=True)
TECHNICAL = replace(CANONICAL, spaced_emdash=True, wrap=78)
PROFILES = {"required": Options(), "canonical": CANONICAL, "technical": TECHNICAL}

_BOLD = r"(?P<bold>\*\*(?P<b>[^*\s](?:[^*\n]*[^*\s:])?)\s*(?:\*\*[ ]?:|[ ]:[ ]?\*\*|:[ ]\*\*))"
_ARROW = r"(?P<arrow>(?<=\w)[ ]?→[ ]?(?=\w))"
_DASH = r"(?P<dash>(?<=[\w\"'”’)\]*_…])[ ]*(?:—|(?<!-)--(?!-))[ ]*(?=[\w\"'“‘(\[*_…]))"
_DOTS = r"(?P<dots>\.[ ]\.[ ]\.(?![ ]?\.)|\.{4,})"
_GAP = r"(?P<gap>(?<=[.!?])(?P<close>[\"'”’)\]]?)[ ]{2,}(?=\S))"
_BEFORE = r"(?P<before>(?<=\w)[ ]+(?=[,;:.!?](?:\s|$)))"
_AFTER = r"(?P<after>(?<=[A-Za-z])[,!?](?=[A-Za-z])|(?<=[a-z]):(?=[A-Z]))"
_QUOTE = r"(?P<quote>\"(?P<q>[.,])(?=$|\s+[A-Z]))"
_ABBREV = r"(?P<abbrev>\b(?:e\.g\.|i\.e\.)(?=[ ]\w))"
_ETAL = r"(?P<etal>\bet[ ]al\b(?!\.))"
_NAMES = {"bold": "emphasis.bold-colon", "arrow": "punct.arrow-aside", "dash": "chicago.emdash-spacing", "dots": "chicago.ellipsis", "gap": "chicago.sentence-space", "before": "chicago.space-before-punct", "after": "chicago.space-after-punct", "quote": "chicago.quote-terminal-punct", "abbrev": "chicago.abbrev-comma", "etal": "chicago.etal-period"}
#: Signs that a match of each can begin with; the patterns are asked only there.
_SIGNS = {_BOLD: "*", _ARROW: " →", _DASH: " —-", _DOTS: ".", _GAP: " \"'”’)]", _BEFORE: " ", _AFTER: ",!?:", _QUOTE: '"', _ABBREV: "ei", _ETAL: "e"}
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec"
UNITS = "mm|cm|m|km|in|ft|yd|mi|mg|g|kg|lb|oz|ml|l|s|ms|min|h|hr|hours?|minutes?|seconds?|days?|mph|kph|am|pm|percent|degrees?|inch(?:es)?|feet|miles?|pounds?|ounces?|liters?|meters?|gallons?"
LABEL_WORDS = "chapters?|volumes?|books?|parts?|sections?|verses?|ch|vol|bk|pt|sec|v|figures?|tables?|pages?|p|step|version"
_LONE = re.compile(rf"(?<![\w.,$/:#%-])[1-9](?![\w.,:/%)\]-])(?! ?(?:{UNITS}|{MONTHS}|%)\b)")
_LABELLED = re.compile(rf"\b(?:{LABEL_WORDS}|{MONTHS})\.? $", re.I)
_SERIAL = re.compile(r"\b\w+, (?:\w+ ){0,3}\w+ (?:and|or) \w+")


@lru_cache(maxsize=16)
def scanner(o: Options) -> re.Pattern | None:
    parts = ([_BOLD] if o.editorial else []) + ([_ARROW] if o.editorial and o.arrow_aside else []) + ([_DASH, _DOTS, _GAP] if o.chicago_punct else []) + ([_BEFORE, _AFTER] + ([_QUOTE] if o.quote_punct else []) if o.chicago_punct2 else []) + ([_ABBREV, _ETAL] if o.chicago_abbrev else [])
    return re.compile(f"(?=[{re.escape(''.join(_SIGNS[p] for p in parts))}])(?:{'|'.join(parts)})") if parts else None


def _spans_kept(s: str) -> list[tuple[int, int]]:
    return [(x.start, x.end) for x in I.scan(s) if x.kind in ("code_span", "link", "image", "raw_inline", "citation", "footnote_ref")]


def scan_line(s: str, rx: re.Pattern, o: Options, hits: set[str]) -> str:
    """The scanner over one line; code, links and citations stay as they are."""
    keep: list[tuple[int, int]] | None = None

    def change(m: re.Match) -> str:
        nonlocal keep
        if keep is None:  # a line without a match isn't scanned for what it holds
            keep = _spans_kept(s)
        busy = bool(keep) or "http" in s
        k = m.lastgroup if m.lastgroup in _NAMES else next(n for n in _NAMES if n in m.groupdict() and m.group(n) is not None)
        if any(a < m.end() and m.start() < b for a, b in keep) or (busy and k in ("before", "after", "quote", "abbrev", "etal")):
            return m[0]
        if k == "dash":
            a, b = s[m.start() - 1 : m.start()], s[m.end() : m.end() + 1]
            if (a.isdigit() and b.isdigit()) or ("--" in m[0] and m[0].startswith(" ") and not m[0].endswith(" ")):
                return m[0]
            new = " — " if o.spaced_emdash and m[0] != "—" else "—"
        else:
            new = {"bold": lambda: f"**{m['b']}:**", "arrow": lambda: "—" if o.chicago_punct else m[0].replace("→", "—"), "dots": lambda: "…", "gap": lambda: m["close"] + " ", "before": lambda: "", "after": lambda: m[0] + " ", "quote": lambda: m["q"] + '"', "abbrev": lambda: m[0] + ",", "etal": lambda: m[0] + "."}[k]()
        if new != m[0]:
            hits.add(_NAMES[k])
        return new

    return rx.sub(change, s)


def width(s: str) -> int:
    """Display columns: wide signs two, combining none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def wrap_lines(lines: list[str], most: int) -> list[str]:
    """A paragraph's lines reflowed to `most` columns where one is far from it; hard breaks stay, and no new line opens a block."""
    out: list[str] = []
    segment: list[str] = []

    def flush() -> None:
        if segment and (len(segment) > 1 or width(segment[0]) > most) and any(width(x) >= most * 3 / 5 for x in segment):
            cur = ""
            for w in " ".join(x.strip(" ") for x in segment).split(" "):
                if cur and width(cur) + 1 + width(w) > most and not _opens(w):
                    out.append(cur)
                    cur = w
                else:
                    cur = f"{cur} {w}" if cur else w
            out.append(cur)
        else:
            out.extend(segment)
        segment.clear()

    for s in lines:
        hard = s.endswith(("  ", "\\", "\t"))
        if hard:
            flush()
            out.append(s)
        else:
            segment.append(s)
    flush()
    return out


def _opens(word: str) -> bool:
    return bool(re.match(r"([-*+>|#=]|\(?(\d+|#|[A-Za-z]|[ivxlcdmIVXLCDM]+|@[\w-]*)[.)]|`{3}|~{3}|<|\[[^\]]*\]:)", word))


def _context(lines: list[str]) -> tuple[list[str], list[dict]]:
    """The kind of block that each line is in, and the blocks."""
    return _context_of("\n".join(lines) + "\n" if lines else "")


@lru_cache(maxsize=2)
def _context_of(text: str) -> tuple[list[str], list[dict]]:
    """Kept for the last texts: a pass asks twice, and where it changed nothing since, or the next begins with what it left, of the same text. Neither list may be changed."""
    lines = text.split("\n")[:-1]
    rec = [r for r in B.parse(text, inlines=False, items=False) if r["depth"] == 0 and r["kind"] != "gap"]
    kinds = ["blank"] * len(lines)
    for r in rec:
        name = "opaque" if r["protected"] and r["kind"] != "code_fence" else r["kind"]
        for k in range(r["line"] - 1, min(r["end_line"], len(lines))):
            kinds[k] = name
        if r["kind"] == "code_fence":
            for k in range(r["line"], r["end_line"] - (0 if r["unterminated"] else 1)):
                kinds[k] = "code"
        if r["kind"] == "table" and r["form"] == "pipe":
            for k in range(r["line"] - 1, r["end_line"]):
                kinds[k] = "pipe"
    quoted = False
    for k, s in enumerate(lines):  # a quote goes on, with or without its sign, up to a blank line, a heading or a fence
        if kinds[k] in ("blank", "heading", "code_fence", "code", "opaque"):
            quoted = False
        elif quoted or kinds[k] == "block_quote" or (kinds[k] == "list" and (m := B.marker(s)) and B.quotes(s[m[1] :])):
            kinds[k], quoted = "block_quote", True
    return kinds, rec


def one_pass(text: str, o: Options, hits: list[tuple[str, int]]) -> str:
    body = text.replace("\r\n", "\n")
    final = body.endswith("\n")
    lines = body.split("\n")
    if final:
        lines.pop()
    did = lambda rule, i: hits.append((rule, i + 1))
    if o.nfc:
        for i, s in enumerate(lines):
            if not s.isascii() and not unicodedata.is_normalized("NFC", s):
                lines[i] = unicodedata.normalize("NFC", s)
                did("unicode.non-nfc", i)
    if o.scrivener:
        i = 0
        while i + 1 < len(lines):
            if re.fullmatch(r" {0,3}#{1,6} ?", lines[i]) and lines[i + 1].strip() and not lines[i + 1].lstrip().startswith("#"):
                lines[i : i + 2] = [lines[i].rstrip() + " " + lines[i + 1].strip()]
                did("heading.scrivener-split", i)
            i += 1
    kinds, rec = _context(lines)
    if o.required:
        _initials(lines, kinds, did)
    rx = scanner(o)
    for i, s in enumerate(lines):
        k, old = kinds[i], s
        if k in ("opaque", "code"):
            continue
        if k == "code_fence":
            if o.fence:
                m = re.match(r"^([ \t]*)(`{3,}|~{3,})[ \t]*(.*?)[ \t]*$", s)
                if m and (new := m[1] + m[2] + m[3]) != s:
                    s = new
                    did("fence.canonical", i)
            lines[i] = s
            continue
        if k in ("reference_def", "blank"):
            if k == "blank" and o.whitespace and s:
                lines[i] = ""
                did("whitespace.trailing", i)
            continue
        if k == "footnote_def" and o.footnote and (m := re.match(r"^( {0,3})\[\^\s*([^\]]*?)\s*\]:[ \t]*(.*)$", s)):
            s = f"{m[1]}[^{m[2]}]: {m[3]}" if m[3] else f"{m[1]}[^{m[2]}]:"
            if s != old:
                did("footnote.def-format", i)
        if o.footnote and (new := re.sub(r"\[\^\s*([^\]\s][^\]]*?)\s*\](?!:)", r"[^\1]", s)) != s:
            s = new
            did("footnote.ref-format", i)
        if o.safe_links and "`" not in s and "](" not in s and (new := re.sub(rf"(?<![<\w(\"'=])({P.URL})", r"<\1>", s)) != s:
            s = new
            did("link.autolink-bare", i)
        if o.editorial and k == "block_quote" and (new := re.sub(r"^([ \t]*>)(?=[^ >\t])", r"\1 ", s)) != s:
            s = new
            did("blockquote.space", i)
        if rx and k not in ("pipe", "block_quote"):
            found: set[str] = set()
            new = scan_line(s, rx, o, found)
            if new != s and _class(new) == _class(s):  # a change of what the line opens is taken back
                s = new
                for r in sorted(found):
                    did(r, i)
        if o.whitespace and (new := _trailing(s, lines[i + 1] if i + 1 < len(lines) else "")) != s:
            s = new
            did("whitespace.trailing", i)
        if o.editorial and k == "list" and (m := re.match(r"^([ \t]*)[*+]([ \t]+\S)", s)):
            s = m[1] + "-" + s[len(m[1]) + 1 :]
            did("list.bullet-style", i)
        if k != "list":
            if k == "heading" and o.editorial and (m := re.match(r"^( {0,3}#+ )(.*)$", s)) and (new := m[1] + re.sub(r"(?<!\\)\*+", "", m[2])) != s:
                s = new
                did("heading.emphasis", i)
            if o.required and k in ("heading", "paragraph") and "#" in s and (m := re.match(r"^( {0,3}#{1,6})(?:([^# ])| {2,}(?=\S))(.*)$", s)):
                s = f"{m[1]} {m[2] or ''}{m[3]}"
                did("heading.atx-space", i)
            if k == "heading" and o.heading and s.lstrip(" ").startswith("#") and (new := re.sub(r"(\S)[ \t]+#+[ \t]*$", r"\1", s)) != s:
                s = new
                did("heading.canonical", i)
        lines[i] = s
    if o.wrap >= 20:
        lines = _wrap(lines, o.wrap)
    if o.required:
        lines = _blank_lines(lines, did)
    return "\n".join(lines) + ("\n" if final else "")


def _class(s: str) -> str:
    return "heading" if re.match(P.ATX, s) else "list" if B.marker(s) else "break" if re.match(P.BREAK, s) else "quote" if re.match(P.QUOTE, s) else "table" if re.match(P.TABLE_ROW, s) else "text"


def _trailing(s: str, nxt: str) -> str:
    if s.endswith("\t"):
        return s
    t = s.rstrip(" ")
    if len(s) - len(t) >= 2 and t.strip() and nxt.strip():
        return t + "  "
    odd = (len(t) - len(t.rstrip("\\"))) % 2
    return t + " " if odd and len(s) > len(t) else t


def _initials(lines: list[str], kinds: list[str], did) -> None:
    """A run of two or more consecutive `A.`, `B.`, ... of one indent gets two blanks after each marker."""
    at, run = [], []
    for i, s in [*enumerate(lines), (len(lines), "")]:
        m = re.match(r"^([ \t]*)([A-Z])\. (?=\S)", s) if ". " in s and kinds[i] not in ("opaque", "code", "code_fence") else None
        if m and run and m[1] == run[-1][1] and ord(m[2]) == ord(run[-1][2]) + 1:
            run.append((i, m[1], m[2]))
        else:
            if len(run) > 1:
                at += run
            run = [(i, m[1], m[2])] if m else []
    for i, a, b in at:
        s = lines[i]
        lines[i] = f"{a}{b}.  {s[len(a) + 2 :].lstrip(' ')}"
        did("list.marker-column", i)


def _wrap(lines: list[str], most: int) -> list[str]:
    kinds, rec = _context(lines)
    out, i = [], 0
    for r in [r for r in rec if r["kind"] == "paragraph"]:
        out += lines[i : r["line"] - 1] + wrap_lines(lines[r["line"] - 1 : r["end_line"]], most)
        i = r["end_line"]
    return out + lines[i:]


def _blank_lines(lines: list[str], did) -> list[str]:
    kinds, rec = _context(lines)
    before, after = set(), set()
    for r in rec:
        if r["kind"] == "list":
            a, b = r["line"] - 1, r["end_line"]
            if a and lines[a - 1].strip() and kinds[a - 1] not in ("list", "block_quote", "opaque"):
                before.add(a)
            if b < len(lines) and lines[b].strip() and kinds[b] not in ("list", "block_quote"):
                after.add(b)
    out = []
    for i, s in enumerate(lines):
        if i in before:
            did("list.blank-before", i)
            out.append("")
        elif i in after:
            did("list.blank-after", i)
            out.append("")
        out.append(s)
    return out


def rewrite(text: str, o: Options = Options()) -> tuple[str, list[tuple[str, int]], bool]:
    """(new text, (rule, line) of the first pass, whether it settled)."""
    hits: list[tuple[str, int]] = []
    new = one_pass(text, o, hits)
    if new == text:
        return new, hits, True
    for _ in range(PASSES - 1):
        again = one_pass(new, o, [])
        if again == new:
            return new, hits, True
        new = again
    return new, hits, one_pass(new, o, []) == new


def lints(text: str, o: Options = Options()) -> list[tuple[str, int]]:
    """(rule, line) of warnings, one a rule and line."""
    lines = text.split("\n")
    kinds, rec = _context(lines)
    out = [("fence.unterminated", r["line"]) for r in rec if r["kind"] == "code_fence" and r["unterminated"]]
    open_ = False
    for i, s in enumerate(lines):
        if not s.isascii() and not unicodedata.is_normalized("NFC", s):
            out.append(("unicode.non-nfc", i + 1))
        if kinds[i] in ("paragraph", "list"):
            if o.serial_comma and _SERIAL.search(s):
                out.append(("chicago.serial-comma", i + 1))
            if o.number_style and any(not _LABELLED.search(s[: m.start()]) for m in _LONE.finditer(s)):
                out.append(("chicago.number-style", i + 1))
            if not open_ and B.doubtful(s):
                out.append(("list.marker-ambiguous", i + 1))
        open_ = kinds[i] == "paragraph"
    return out


RESULT = "doc_id bigint, path string, text string, hits array<struct<rule:string,line:int>>, settled boolean"


def rewrite_documents(docs: DataFrame, options: Options = Options()) -> DataFrame:
    """docs with the new text, hits and whether the rewrite settled."""

    def run(batches):
        for b in batches:
            got = [(t, [], True) if t is None else rewrite(t, options) for t in b["text"].to_pylist()]
            each = [x for _, h, _ in got for x in h]
            upto = pa.array([0, *itertools.accumulate(len(h) for _, h, _ in got)], pa.int32())
            hits = pa.ListArray.from_arrays(upto, pa.StructArray.from_arrays([pa.array([r for r, _ in each], pa.string()), pa.array([n for _, n in each], pa.int32())], ["rule", "line"]))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["path"], pa.array([t for t, _, _ in got], pa.string()), hits, pa.array([s for _, _, s in got])], names=["doc_id", "path", "text", "hits", "settled"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("path") if "path" in docs.columns else F.lit(None).cast("string").alias("path"), "text")
    return spread(src).mapInArrow(run, RESULT)


def lint_documents(docs: DataFrame, options: Options = Options()) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(d, r, n) for d, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) if t for r, n in lints(t, options)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32()))], names=["doc_id", "rule", "line"])

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, rule string, line int")


def hits(rewritten: DataFrame) -> DataFrame:
    """(doc_id, rule, line), each once."""
    return rewritten.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.rule", "h.line").distinct()


def summary(rewritten: DataFrame) -> DataFrame:
    return hits(rewritten).groupBy("doc_id", "rule").agg(F.count("*").alias("n"))


def canonical_gate(docs: DataFrame, options: Options = CANONICAL) -> DataFrame:
    """(doc_id, verdict): 0 canonical, 1 not yet, 2 unsettled."""
    new = rewrite_documents(docs, options).select("doc_id", F.col("text").alias("new"), "settled")
    return docs.join(new.hint("merge"), "doc_id").select("doc_id", F.when(~F.col("settled"), 2).when(F.col("new") != F.col("text"), 1).otherwise(0).alias("verdict"))


def introduces_dirt(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents in which an edit made more required repairs necessary than there were."""
    n = lambda d, c: rewrite_documents(d).select("doc_id", F.size(F.filter("hits", lambda h: h["rule"].isin(*REQUIRED))).alias(c))
    return n(before, "before").join(n(after, "after").hint("merge"), "doc_id").where("after > before")
