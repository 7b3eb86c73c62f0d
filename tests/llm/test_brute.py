"""Scores, pages and the whole pipeline against plain loops over small tables."""

from __future__ import annotations

import math
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from test_text_ops import DOC, brute_private, docs, near_classes, slow_fit

from quillspan.llm import html_extract, langid, packing, pii, quality, sp_codec, tokens
from quillspan.llm.common import LOWER, buffers, span_hashes, word_spans


def hashed(gram: bytes) -> int:
    """The bucket of a character n-gram, a byte at a time."""
    n, m = len(gram), 0xFFFFFFFF
    h = gram[0]
    for c in gram[1:]:
        h = (h * 0x01000193 & m) ^ c
    h = h * (0x9E3779B1 + 2 * n & m) & m
    h ^= h >> 15
    return (h * 0x85EBCA77 & m) >> (32 - quality.BUCKET_BITS)


def plain_p(text: str, model) -> float:
    """The probability of junk from the grams of a text one by one."""
    raw, offs = buffers(pa.array([text], pa.large_string()))
    low = bytes(LOWER[raw])
    found = [hashed(low[k : k + n]) for n in quality.NGRAMS for k in range(len(low) - n + 1)]
    start, end, _ = word_spans(raw, offs)
    words = span_hashes(LOWER[raw], start, end).tolist() if len(start) else []
    shift, m = 64 - quality.BUCKET_BITS, (1 << 64) - 1
    found += [w >> shift for w in words]
    found += [(((b - a) & m) * 0x9FB21C651E98DF25 & m) >> shift for a, b in zip(words, words[1:])]
    if not found:
        return 0.0
    z = sum(float(model.table[b, 1]) for b in found) / len(found) + float(model.bias[1]) - float(model.bias[0])
    return 1 / (1 + math.exp(-z))


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    good, bad = "the of and river stone light over under".split(), "a%%% b### c$$$ win now".split()
    return [" ".join(rng.choice(good if i % 3 else bad) + rng.choice(["", "", "é", "7"]) for _ in range(rng.randrange(1, 50))) for i in range(n)]


def test_quality_is_brute_force(spark):
    rows = [*enumerate(texts(1, 90)), (None, "river"), (200, None), (201, ""), (202, "a"), (3, "stone light"), (203, "river of stone " * 7000)]
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)] + [(4, 0)], "doc_id long, quality int")
    d = docs(spark, rows).repartition(3)
    model = quality.fit(d, lab)
    got = sorted(((r.doc_id, round(r.p_junk, 5), r.keep) for r in quality.classify(d, lab).collect()), key=str)
    want = sorted(((i, round(p, 5), p < quality.THRESHOLD) for i, t in rows for p in [plain_p(t or "", model)]), key=str)
    assert [x[::2] for x in got] == [x[::2] for x in want] and np.allclose([x[1] for x in got], [x[1] for x in want], atol=2e-5)
    assert quality.classify(docs(spark, []), lab).count() == 0


def test_language_without_its_column(spark):
    d = docs(spark, [(1, "a b"), (1, "a b"), (2, None)])
    assert sorted(str((r.doc_id, r.language)) for r in langid.identify(d).collect()) == ["(1, None)", "(1, None)", "(2, None)"]
    clash = d.selectExpr("*", "'x' AS lang", "1 AS language", "2 AS spans", "3 AS nth")
    assert {r.language for r in langid.identify(clash).collect()} == {"x", None}


def plain_pages(rows):
    """(page_id, content, template texts) by one template a host and counts in dicts."""
    hosts: dict = {}
    for i, h, p in rows:
        hosts.setdefault(h, []).append((i, *html_extract.structure(p)))
    out = []
    for host, pages in hosts.items():
        t = html_extract.structure("")[0]
        for p in (p for _, h, p in rows if h == host):
            html_extract.merge(t, html_extract.structure(p)[0])  # a tree of its own, as the template takes nodes from it
        html_extract.number(t)
        seen = {}
        for _, tree, every, form in pages:
            seen[form, tuple(every)] = set(zip(html_extract.slots(t, tree, len(every)), every))
        have = Counter(x for s in seen.values() for x in s if x[0] >= 0)
        nodes = Counter(n for s in seen.values() for n in {n for n, _ in s} if n >= 0)
        every_, again = Counter(), Counter()
        for (n, _), c in have.items():
            every_[n] += c
            again[n] += c if c > 1 else 0
        site = {(n, x) for (n, x), c in have.items() if c > 1 and (2 * c > nodes[n] or 2 * again[n] > every_[n])}
        for i, tree, every, _ in pages:
            keep = [x for x, n in zip(every, html_extract.slots(t, tree, len(every))) if (n, x) not in site]
            out.append((i, "\n".join(keep), len(every) - len(keep)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 5])
def test_pages_are_brute_force(spark, parts):
    rng = random.Random(6)
    rows = []
    for i in range(150):
        h = rng.randrange(3)
        ad = f"<aside><b>Ad {rng.randrange(4)}</b></aside>" if rng.random() < 0.5 else ""
        body = "".join(f"<p>Text {rng.randrange(200)} of {h}.</p>" for _ in range(rng.randrange(5)))
        extra = f"<table><tr><td>Cell {i}</td></tr></table>" if h == 1 and rng.random() < 0.3 else ""
        rows.append((i, f"h{h}.com", f"<nav><a>Home {h}</a></nav><h1>Title {i // 2}</h1>{ad}<div class='m'>{body}</div>{extra}<footer>Site {h}</footer>"))
    rows += [(1000 + i, *rows[i][1:]) for i in range(20)]  # rows that repeat
    d = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, h, p in rows], "page_id long, url string, html string").repartition(parts)
    got = sorted((r.page_id, r.content, r.n_template) for r in html_extract.content(d).collect())
    assert got == plain_pages(rows) and sum(x[2] for x in got) > 300


def test_very_long_texts(spark):
    long = "river stone " * 10_000
    d = docs(spark, [(1, long)]).selectExpr("*", "1 AS n_tokens", "2 AS ids", "'c' AS content")
    assert tokens.prefix_counts(d).first().n_chars == len(long)
    e = sp_codec.encode(d)
    assert e.first().round_trip and sp_codec.decode(e).first().text == long
    page = spark.createDataFrame([(1, "http://a.com/", "<div>" * 300 + "<p>x</p>" * 5000 + "end")], "page_id long, url string, html string")
    assert html_extract.content(page).first().content.endswith("end")


def pipeline(tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    return pytest.importorskip("corpus_pipeline")


def write(spark, folder, rows, labels):
    docs(spark, rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_is_brute_force(spark, tmp_path):
    run = pipeline(tmp_path)
    rng = random.Random(12)
    base = texts(3, 120)
    secret = ["mail jo.doe@mail.example.com", "call +1 (415) 555-2671", "token = 0123abcdef4567890123", "from 10.20.30.40", "card 4111111111111111", ""]
    base = [t + " " + rng.choice(secret) for t in base]
    base += [base[i] for i in range(0, 40, 3)] + [base[i].replace("river", "riverside", 1) for i in range(1, 60, 4)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)] + [(900, None, None, None, None), (901, "", "en", "s", 0), (None, base[1], "en", "s", 1), (None, base[1], "en", "s", 1), (902, "stone light " * 3000, "en", "s", 1)]
    write(spark, tmp_path, rows, [(i, int(i % 3 > 0), 0) for i in range(0, 120, 2)])
    got = run.run(spark, str(tmp_path)).collect()

    model = quality.fit(docs(spark, rows, DOC), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = [(i, t) for i, t, *_ in rows if plain_p(t or "", model) < quality.THRESHOLD]
    first: dict = {}
    for i, t in kept:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
    kept = [(i, t) for i, t in kept if i is None or t is None or first[t] == i]
    lost = {i for i, c, _ in near_classes(kept) if i is not None and c != i}
    kept = [(i, t) for i, t in kept if i not in lost]
    whole = list(enumerate(t for _, t in kept))
    spans: dict = {}
    for n, s, e, kind, _ in brute_private(whole):
        spans.setdefault(n, []).append((s, e, kind))
    clean = []
    for n, t in whole:
        for s, e, kind in sorted(spans.get(n, ()), reverse=True):
            t = t[:s] + f"<{kind.upper()}>" + t[e:]
        clean.append((kept[n][0], t))
    enc, want, sizes = packing.encoder(), [], []
    for i, t in clean:
        tok = enc.encode_ordinary(t or "")
        for part in range(max(1, -(-len(tok) // packing.CHUNK))):
            own = tok[part * packing.CHUNK : (part + 1) * packing.CHUNK]
            want.append(str((i, part, own)))
            sizes += [len(own)] if own else []
    assert sorted(str((r.doc_id, r.part, r.tokens)) for r in got) == sorted(want)
    sizes.sort(reverse=True)
    plain, bins = {}, {}
    for n, b in zip(sizes, slow_fit(sizes, (packing.TOKENS, packing.DOCUMENTS, packing.ATTENTION), "norm")):
        plain.setdefault(b, []).append(n)
    for r in got:
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r.n_tokens)
    assert sorted(map(sorted, bins.values())) == sorted(map(sorted, plain.values()))
    assert len(spans) > 20 and len(lost) > 3 and len(kept) < len(rows) - 40


def test_pipeline_of_an_empty_table(spark, tmp_path):
    run = pipeline(tmp_path)
    write(spark, tmp_path, [], [])
    out = run.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["bin_id", "doc_id", "part", "start", "n_tokens", "tokens"]
