"""The parser and inline scanner on documents as authors write them."""

from __future__ import annotations

import random

import pytest

from quillspan.operators import blocks as B
from quillspan.operators import inline as I
from quillspan.operators import prose as Z
from quillspan.operators import rewrite as W
from quillspan.operators import terms as T

PARTS = ["# T\n", "Text *a* `b`.\n", "\n", "- x\n", "  cont\n", "1. y\n", "> q\n", "```py\ncode\n```\n", "```\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", "    code\n", "[r]: http://x\n", "[^n]: note\n", "<!-- c -->\n", "***\n", "Head\n====\n", "é ü\n", "\t- t\n", "a  b  \n", "---\n", "A. x\n"]


def spans_hold(text):
    raw, at = text.encode(), 0
    for r in B.parse(text):
        assert 0 <= r["start"] <= r["end"] <= len(raw)
        raw[r["start"] : r["end"]].decode()
        if r["depth"] == 0:
            assert r["start"] == at
            at = r["end"]
    assert at == len(raw)


@pytest.mark.parametrize("seed", range(60))
def test_spans_are_total(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
    for t in (text, text.rstrip("\n"), text.replace("\n", "\r\n"), "﻿" + text):
        spans_hold(t)


@pytest.mark.parametrize("seed", range(40))
def test_rewrites_settle(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 10)))
    new, _, settled = W.rewrite(text, W.CANONICAL)
    assert settled and W.rewrite(new, W.CANONICAL)[0] == new


def kinds(text):
    return [r["kind"] for r in B.parse(text) if r["depth"] == 0 and r["kind"] != "gap"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("---\na: 1\n---\n# T\n", ["frontmatter", "heading"]), ("---\ntext\n", ["thematic_break", "paragraph"]), ("para\n\n    code\n", ["paragraph", "code_indented"]), ("- a\n\n  b\n- c\n", ["list"]), ("- a\n1. b\n", ["list", "list"]),
        ("~~~\nx\n~~~~\ny\n", ["code_fence", "paragraph"]), ("<script>\na\n\nb\n</script>\nc\n", ["raw_html", "paragraph"]), ("+--+\n| a|\n+--+\n", ["table"]), ("  a   b\n --- ---\n  1   2\n\nx\n", ["table", "paragraph"]), ("| a\n| b\n", ["line_block"]), ("a | b\n--|--\n1 | 2\n", ["table"]), ("", []),
    ],
)
def test_blocks(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize(
    "s,want",
    [
        ("*a* **b** _c_", ["emphasis", "strong", "emphasis"]), ("***a***", []), ("snake_case_x", []), ("*a *b* c*", []), ("[t](u) ![i](v)", ["link", "image"]), ("[^n] [r][l] [s]", ["footnote_ref", "link", "link"]), ("<http://x> <b>", ["link", "raw_inline"]),
        ("@k a@b.c [see @x; -@y]", ["citation", "citation", "citation"]), ("``a`b`` \\*c*", ["code_span"]), ("[@a](u)", ["link"]),
    ],
)
def test_inline(s, want):
    assert [x.kind for x in I.scan(s)] == want


def test_plain_text_of_a_heading():
    assert I.plain("The **big** [idea](x) `code` <b>x</b> [ref][l]") == "The big idea code x [ref][l]"


@pytest.mark.parametrize("text", ['He said "Hello." Then left. See 1.) here. (A note.) End', " a. B! C? d", "", "One", "Dr. Smith came."])
def test_sentences_rebuild_their_text(text):
    spans = Z.sentence_spans(text)
    assert Z.reconstruct(text, spans, {}) == text and all(text[a:b] == text[a:b].strip() for a, b in spans)
    if spans:
        assert Z.reconstruct(text, spans, {0: "X."}).lstrip().startswith("X.")


@pytest.mark.parametrize("raw,want", [('{"accept": true, "reason": "ok"}', (True, "ok")), ('<think>{"accept": true}</think> no', (False, "no verdict")), ('{"accept": "true"}', (False, "")), ('{"accept": true} {"accept": false}', (False, "")), (None, (False, "no verdict"))])
def test_judgements_fail_closed(raw, want):
    assert Z.parse_judgement(raw) == want


@pytest.mark.parametrize("bad", [[{"term": ""}], [{"term": "a"}, {"term": "A"}], [{"term": "a", "aliases": [""]}], [{"term": "a", "aliases": ["b"], "forbidden": ["B"]}], [{"term": "a", "forbidden": ["A"]}], [{"term": "a", "expansion": "A"}]])
def test_glossaries_that_contradict_themselves(bad):
    with pytest.raises(ValueError):
        T.load(bad)
