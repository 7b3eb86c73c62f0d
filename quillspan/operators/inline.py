"""Inline constructs of one line: code, links, citations, footnotes, emphasis, raw tags."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

from quillspan.functions import patterns as P

PAIRS_A_LINE, OPENERS = 64, 32
_TICKS = re.compile("`+")
_AUTOLINK = re.compile(r"<(?=[^<> \t]*[:@])[^<> \t]+>")
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->")
_FOOTNOTE = re.compile(P.FOOTNOTE_REF)
_KEY = re.compile(P.CITE_KEY)
_INTEREST = re.compile(r"[`<\[@*_\\!]")


class Inline(NamedTuple):
    kind: str
    start: int
    end: int
    text: str | None = None
    text_start: int | None = None
    text_end: int | None = None
    form: str | None = None
    label: str | None = None
    destination: str | None = None
    dest_start: int | None = None
    dest_end: int | None = None
    mode: str | None = None


def is_word(ch: str) -> bool:
    return ch.isalpha() or unicodedata.category(ch) in ("Nd", "Mn", "Mc")


def code_end(s: str, i: int) -> int:
    """End of the code span that opens at i, or i."""
    run = _TICKS.match(s, i)
    if not run:
        return i
    for m in _TICKS.finditer(s, run.end()):
        if m.end() - m.start() == run.end() - run.start():
            return m.end()
    return i


def angle_end(s: str, i: int) -> tuple[int, str]:
    if m := _AUTOLINK.match(s, i):
        return m.end(), "autolink"
    if m := _TAG.match(s, i):
        return m.end(), "tag"
    return i, ""


def close_bracket(s: str, i: int, opening: str = "[", closing: str = "]") -> int:
    """The bracket that closes the one at i, or -1; escapes don't count."""
    depth, k = 0, i
    while k < len(s):
        c = s[k]
        if c == "\\":
            k += 2
            continue
        if c == opening:
            depth += 1
        elif c == closing:
            depth -= 1
            if not depth:
                return k
        k += 1
    return -1


def link_at(s: str, i: int) -> tuple[int, int, int] | None:
    """(text start, text end, end) of an inline link or image at i."""
    a = i + 1 if s[i] == "!" else i
    if a >= len(s) or s[a] != "[":
        return None
    b = close_bracket(s, a)
    if b < 0 or b + 1 >= len(s) or s[b + 1] != "(":
        return None
    e = close_bracket(s, b + 1, "(", ")")
    return None if e < 0 else (a + 1, b, e + 1)


def bare_destination(s: str, a: int, b: int) -> tuple[int, int]:
    """The span of the destination alone inside [a, b): no blanks, angle brackets or title."""
    while a < b and s[a] in " \t":
        a += 1
    if a < b and s[a] == "<":
        e = s.find(">", a, b)
        return (a + 1, e) if e >= 0 else (a + 1, b)
    e = a
    while e < b and s[e] not in " \t":
        e += 2 if s[e] == "\\" and e + 1 < b else 1
    return a, min(e, b)


def emphasis(s: str) -> list[Inline]:
    """Pairs of equal runs of one or two markers; none where another run of the marker could interfere."""
    if "*" not in s and "_" not in s:
        return []
    stack: list[list] = []  # position, length, marker, disturbed
    out: list[Inline] = []
    i, n = 0, len(s)
    while m := _INTEREST.search(s, i):
        i = m.start()
        c = s[i]
        if c == "\\" and i + 1 < n:
            i += 2
            continue
        if c == "`" and (e := code_end(s, i)) > i:
            i = e
            continue
        if c == "<" and (e := angle_end(s, i)[0]) > i:
            i = e
            continue
        if (c == "[" or s.startswith("![", i)) and (m := link_at(s, i)):
            i = m[2]
            continue
        if c not in "*_":
            i += 1
            continue
        j = i
        while j < n and s[j] == c:
            j += 1
        before, after = s[i - 1 : i], s[j : j + 1]
        can_open = bool(after) and not after.isspace()
        can_close = bool(before) and not before.isspace()
        if c == "_":
            can_open = can_open and not (before and is_word(before))
            can_close = can_close and not (after and is_word(after))
        match = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][2] == c), -1) if can_close else -1
        others = False
        for k, o in enumerate(stack):
            if o[2] == c and k != match:
                o[3], others = True, True
        if match >= 0:
            pos, size, _, disturbed = stack[match]
            if size == j - i and size <= 2 and not disturbed and not others and len(out) < PAIRS_A_LINE:
                out.append(Inline("strong" if size == 2 else "emphasis", pos, j, s[pos + size : i], pos + size, i))
            del stack[match:]
        elif can_open and len(stack) < OPENERS:
            stack.append([i, j - i, c, False])
        i = j
    return sorted(out, key=lambda x: x.start)


def _after_word(s: str, at: int) -> bool:
    return at > 0 and (s[at - 1] == "." or is_word(s[at - 1]))


def _keys(s: str, a: int, b: int):
    for m in _KEY.finditer(s, a, b):
        if not _after_word(s, m.start()):
            yield m


def _cite_bracket(s: str, i: int) -> int:
    """The end of a bracket at i that holds a citation, else -1."""
    e = i + 1
    while e < len(s) and s[e] not in "[]":
        e += 1
    if e >= len(s) or s[e] != "]" or s[e + 1 : e + 2] in ("(", "["):
        return -1
    return e + 1 if next(_keys(s, i + 1, e), None) else -1


def _example_marker(s: str, at: int) -> bool:
    k = len(s) - len(s.lstrip(" \t"))
    if s[k : k + 1] == ">":
        k += 1
        k += len(s[k:]) - len(s[k:].lstrip(" \t"))
    m = _KEY.match(s, at)
    e = m.end() if m else at + 1
    if s[k : k + 1] == "(" and at == k + 1:
        return s[e : e + 1] == ")"
    return at == k and s[e : e + 1] == "." and s[e + 1 : e + 2] in ("", " ")


def _in_bracket(s: str, at: int) -> bool:
    a = max(s.rfind("[", 0, at), s.rfind("]", 0, at))
    if a < 0 or s[a] == "]":
        return False
    for k in range(at + 1, len(s)):
        if s[k] == "[":
            return False
        if s[k] == "]":
            return s[k + 1 : k + 2] != "("
    return False


def _cite(m: re.Match, s: str, bracketed: bool) -> Inline:
    mode = "in-text" if not bracketed else ("suppress-author" if m.start() and s[m.start() - 1] == "-" else "normal")
    return Inline("citation", m.start(), m.end(), m[1], m.start() + 1, m.end(), mode=mode)


def scan(s: str, block_start: bool = False) -> list[Inline]:
    """Every inline construct of a line in source order; the first claim on a place wins."""
    if not _INTEREST.search(s):
        return []
    pairs, p, out, i, n = emphasis(s), 0, [], 0, len(s)
    while at := _INTEREST.search(s, i):
        i = at.start()
        while p < len(pairs) and pairs[p].start < i:
            p += 1
        while p < len(pairs) and pairs[p].start == i:
            out.append(pairs[p])
            p += 1
        c = s[i]
        if c == "\\" and i + 1 < n:
            i += 2
            continue
        if c == "`" and (e := code_end(s, i)) > i:
            w = _TICKS.match(s, i).end() - i
            out.append(Inline("code_span", i, e, s[i + w : e - w]))
            i = e
            continue
        if c == "@" and not _after_word(s, i) and (m := _KEY.match(s, i)) and not (block_start and _example_marker(s, i)):
            out.append(_cite(m, s, _in_bracket(s, i)))
            i = m.end()
            continue
        if c == "<":
            e, what = angle_end(s, i)
            if what == "autolink":
                out.append(Inline("link", i, e, form="autolink", destination=s[i + 1 : e - 1], dest_start=i + 1, dest_end=e - 1))
            elif what:
                out.append(Inline("raw_inline", i, e))
            if what:
                i = e
                continue
        if c == "[" and (e := _cite_bracket(s, i)) > 0:
            out += [_cite(m, s, True) for m in _keys(s, i + 1, e - 1)]
            i = e
            continue
        image = s.startswith("![", i)
        if c == "[" or image:
            if not image and (m := _FOOTNOTE.match(s, i)):
                out.append(Inline("footnote_ref", i, m.end(), label=m[1]))
                i = m.end()
                continue
            kind = "image" if image else "link"
            if m := link_at(s, i):
                a, b = bare_destination(s, m[1] + 2, m[2] - 1)
                span = (a, b) if b > a else (None, None)
                out.append(Inline(kind, i, m[2], s[m[0] : m[1]], form="inline", destination=s[a:b] if b > a else None, dest_start=span[0], dest_end=span[1]))
                i = m[2]
                continue
            a = i + image
            b = close_bracket(s, a)
            if b >= 0 and s[b + 1 : b + 2] != "(":
                text, label, e, form = s[a + 1 : b], s[a + 1 : b], b + 1, "shortcut"
                if s[b + 1 : b + 2] == "[":
                    z = b + 2
                    while z < n and s[z] not in "[]":
                        z += 1
                    if z >= n or s[z] != "]":
                        i += 1
                        continue
                    label, e, form = s[b + 2 : z], z + 1, "reference"
                out.append(Inline(kind, i, e, text, form=form, label=label))
                i = e
                continue
        i += 1
    return out


def plain(s: str, depth: int = 0) -> str:
    """Heading text without inline markup; reference links stay as written."""
    if depth > 24 or not _INTEREST.search(s):
        return s
    marks = [m for m in emphasis(s)]
    cut = sorted([(m.start, m.text_start) for m in marks] + [(m.text_end, m.end) for m in marks])
    out, i, c = [], 0, 0
    while i < len(s):
        while c < len(cut) and cut[c][0] < i:
            c += 1
        if c < len(cut) and cut[c][0] == i:
            i = cut[c][1]
            continue
        ch = s[i]
        if ch == "\\" and i + 1 < len(s) and not s[i + 1].isalnum():
            out.append(s[i + 1])
            i += 2
            continue
        if ch == "`" and (e := code_end(s, i)) > i:
            w = _TICKS.match(s, i).end() - i
            out.append(s[i + w : e - w])
            i = e
            continue
        if ch == "<":
            e, what = angle_end(s, i)
            if what:
                out.append(s[i + 1 : e - 1] if what == "autolink" else "")
                i = e
                continue
        if (ch == "[" or s.startswith("![", i)) and (m := link_at(s, i)):
            out.append(plain(s[m[0] : m[1]], depth + 1))
            i = m[2]
            continue
        out.append(ch)
        i += 1
    return "".join(out)
