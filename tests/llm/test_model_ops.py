"""Search, tokenizers, language and pages against brute force, the libraries and held-out rows."""

from __future__ import annotations

import base64
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from quillspan.llm import html_extract, langid, sp_codec, tokens, topk


def brute(rows, k, every=1):
    out = []
    for i, v in rows:
        if i % every == 0:
            d = sorted((float(np.sqrt(((np.float32(v).astype(float) - np.float32(w).astype(float)) ** 2).sum())), j) for j, w in rows if j != i)[:k]
            out += [(i, r + 1, j, round(x, 5)) for r, (x, j) in enumerate(d)]
    return sorted(out)


@pytest.mark.parametrize("every,bundle", [(1, 8192), (7, 2), (50, 8192)])
def test_topk_is_brute_force(spark, monkeypatch, every, bundle):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "BUNDLE", bundle)
    rng = np.random.default_rng(0)
    centers = rng.normal(0, 3, (5, 8))
    rows = [(i, (centers[i % 5] + rng.normal(0, 0.5, 8)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]  # ties
    got = topk.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 5, every)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, every)


def table(x, pivots):
    return np.sqrt(((x[:, None].astype(float) - pivots) ** 2).sum(axis=2)).astype(np.float32)


def test_topk_of_far_vectors():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1e-3, (400, 4)) + np.array([1000.0, 0, 0, 0])).astype(np.float32)
    pd = table(x, np.array([[-1000.0, 0, 0, 0], [3000.0, 5, 0, 0], [0, 2000.0, 1, 1]]))
    d = np.sqrt(((x[:, None].astype(float) - x.astype(float)) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    tau = np.sort(d, axis=1)[:, 4] * (1 + 1e-6)
    q, n, *_ = topk.search_block(np.arange(400), x, pd, tau, np.arange(400), x, pd, 5)
    want = {(i, j) for i in range(400) for j in np.flatnonzero(d[i] <= np.sort(d[i])[4])}
    assert want <= set(zip(q.tolist(), n.tolist()))


def test_topk_stops_at_the_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (2000, 3)).astype(np.float32)
    pd = table(x, topk.farthest_first(x.astype(float), 16))
    d = np.sqrt(((x[:50, None].astype(float) - x.astype(float)) ** 2).sum(axis=2))
    d[np.arange(50), np.arange(50)] = np.inf
    kth = np.sort(d, axis=1)[:, 4]
    *_, evaluated = topk.search_block(np.arange(50), x[:50], pd[:50], np.full(50, np.inf), np.arange(2000), x, pd, 5)
    bound = np.abs(pd[:50, None] - pd[None]).max(axis=2)
    needed = int(((bound <= kth[:, None] + 1e-4) & np.isfinite(d)).sum())
    assert needed - 50 <= evaluated <= needed + 50 * topk.STEP  # a step at most beyond the stop of a query
    assert evaluated < 0.1 * 50 * 2000


def test_topk_of_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (None, [0.0, 0.0]), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [5.0, 0.0]), (8, [])]
    d = spark.createDataFrame([(*r, 1.0, 2, 3) for r in rows], "vec_id long, embedding array<float>, distance double, block int, q int")
    got = sorted(map(tuple, topk.neighbours(d, 3, 1).collect()))
    assert got == [(1, 1, 2, 1.0), (1, 2, 7, 5.0), (2, 1, 1, 1.0), (2, 2, 7, 4.0), (7, 1, 2, 4.0), (7, 2, 1, 5.0)]
    assert topk.neighbours(d, 3, 2).count() == 2 and topk.neighbours(d.limit(0)).count() == 0


CASES = ["", " ", "it's they'll 'lx 're", "a   b", "  x\n\n y  ", "日本語 テスト", "é①ﬁ\n\nx\ty", "🎉🎉 party", "a" * 300, "....... !!", "x\t\ty  z", "\n\n\nword", "the Thonwhst. erthand, 12345 a1b2"]


def cases():
    rng = random.Random(1)
    return CASES + ["".join(rng.choice("abthe '\n\t.1é字🎉") for _ in range(40)) for _ in range(80)]


def test_counts_of_every_prefix():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(tokens.VOCABULARY).read_bytes().splitlines())}
    pat = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("own", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    pc = tokens.PrefixCounter()
    for c in cases():
        table = pc.table(c)
        want = [len(enc.encode_ordinary(c[: i + 1])) for i in range(len(c))]
        assert tokens.counts(table).tolist() == want
        assert tokens.count_at(table, len(c)) == len(enc.encode_ordinary(c))
        for budget in (0, 3, 10):
            assert tokens.cut_at(table, budget) == max([i + 1 for i, n in enumerate(want) if n <= budget], default=0)


def test_prefix_count_rows(spark):
    rows = [(1, "one two three " * 200, 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "x", 5)]
    got = tokens.prefix_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), (10, 1000)).collect()
    by = {(r.doc_id, r.n_chars): r for r in got}
    r = by[1, 2800]
    assert len(got) == 5 and r.n_tokens == int(tokens.counts(r.prefix_deltas)[-1]) and tokens.count_at(r.prefix_deltas, r.cut_10) <= 10 and r.cut_1000 is None
    assert by[2, None].n_tokens is None and by[3, 0].n_tokens == 0 and by[None, 1].n_tokens == 1
    assert tokens.prefix_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_codec_is_the_library():
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp_codec.MODEL)
    c, texts = sp_codec.codec(), [*cases(), "▁▁ x▁y"]
    ids, many = c.encode(texts)
    at = 0
    for t, n, back in zip(texts, many.tolist(), c.decode(ids, many)):
        assert ids[at : at + n].tolist() == sp.encode(t)
        assert back == t.replace("▁", " ")
        at += n
    assert c.encode([])[0].tolist() == []


def test_codec_sorts_few_times(monkeypatch):
    """Pairs met are looked up, not sorted into all known ones at each place; suffixes are sorted twice a batch of few signs."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghij    é漢\0") for _ in range(rng.randrange(90))) for _ in range(200)] + [" " * n for n in range(20)] + ["abc" * 300]
    c, big = sp_codec.Codec(), []
    sort = np.argsort
    ids, many = c.encode(texts[:120])
    monkeypatch.setattr(np, "argsort", lambda x, **k: big.append(len(x)) or sort(x, **k))
    more, n = c.encode(texts)
    assert len(big) <= 5  # it was one for each place in the longest unit besides
    monkeypatch.undo()
    assert more[: len(ids)].tolist() == ids.tolist() and n[:120].tolist() == many.tolist()
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=sp_codec.MODEL)
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends):
        assert more[a:b].tolist() == sp.encode(t)
    assert c.decode(more, n) == texts


def test_codec_rows(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "x  y"), (1, "Hello world"), (4, "ab " * 30_000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    e = sp_codec.encode(d)
    got = e.collect()
    assert [r.round_trip for r in got if r.doc_id != 2] == [True] * 5 and [r.ids for r in got if r.doc_id == 2] == [None]
    assert sorted((str(r.doc_id), str(r.text)) for r in sp_codec.decode(e).collect()) == sorted((str(i), str(t)) for i, t in rows)
    assert sp_codec.encode(d.limit(0)).count() == 0


def chain(e, tr):
    n, k = e.shape
    al, be = np.zeros((n, k)), np.zeros((n, k))
    al[0] = e[0]
    for i in range(1, n):
        al[i] = e[i] + np.logaddexp.reduce(al[i - 1][:, None] + tr, axis=0)
    for i in range(n - 2, -1, -1):
        be[i] = np.logaddexp.reduce(tr + (e[i + 1] + be[i + 1])[None, :], axis=1)
    p = np.exp(al + be - (al + be).max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_blocked_forward_backward_is_exact(block):
    rng = np.random.default_rng(0)
    size = np.array([1, 5, 64, 65, 200, 3, 128])
    e, tr = rng.normal(0, 3, (size.sum(), 4)), rng.normal(0, 2, (4, 4))
    want = np.concatenate([chain(x, tr) for x in np.split(e, np.cumsum(size)[:-1])])
    assert np.abs(langid.posteriors(e, tr, size, block) - want).max() < 1e-9


def speech(rng, lang, n):
    parts = {"aa": ["tion", "the", "ing", "er"], "bb": ["eau", "oui", "ç", "le"], "cc": ["sch", "ung", "ü", "der"]}[lang]
    return [("".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))) for _ in range(n)]


def test_language_of_switched_text(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(speech(rng, lang, 60)), lang) for i in range(90) for lang in [("aa", "bb", "cc")[i % 3]]]
    mixed = speech(rng, "aa", 20) + speech(rng, "bb", 20) + speech(rng, "cc", 20)
    extra = [(500, " ".join(mixed), None), (501, None, "aa"), (502, "", "aa"), (None, "the tion ing", "aa"), (503, "tioning " * 30_000, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string"), per_lang=15).collect()}
    assert sum(got[i].language == lang for i, _, lang in rows) >= 88
    labels = [s.lang for s in got[500].spans for _ in range(s.end - s.start)]
    assert len(labels) == 60 and sum(a == b for a, b in zip(labels, ["aa"] * 20 + ["bb"] * 20 + ["cc"] * 20)) >= 55
    assert got[501].language is None and got[502].spans == [] and got[None].language == "aa" and got[503].n_words == 30_000
    none = langid.identify(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].language is None
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def page(i, n=3):
    body = "".join(f"<p>Unique text {i} part {j}.</p>" for j in range(n))
    return f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style></head><body><nav><ul><li><a href="/x">Home</a></li><li>About</li></ul></nav><!-- c --><div class="main"><h1>Title {i}</h1>{body}</div><footer>&copy; Site</footer></body></html>'


def test_wrapper_induction(spark):
    rows = [(i, f"http://www.a.com/p/{i}", page(i, 1 + i % 4)) for i in range(30)]
    rows += [(100, "http://single.org/", page(7)), (101, None, page(8)), (102, "http://www.a.com/q", None), (103, "http://www.a.com/r", ""), (None, "http://www.a.com/s", page(50)), (104, "not a url", "<p>x"), (105, "http://www.a.com/t", "<div>" * 3000 + "deep")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, content string").repartition(3)
    got = {r.page_id: r for r in html_extract.content(d).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 3, 29):
        assert got[i].content.split("\n") == [f"Title {i}"] + [f"Unique text {i} part {j}." for j in range(1 + i % 4)] and got[i].n_template == 3
    assert "Home" in got[100].content and "Home" in got[101].content and got[102].content is None and got[103].content == "" and "T7" not in got[100].content
    assert html_extract.content(d.limit(0)).count() == 0


def test_wrapper_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 2}.com/{i}", page(i)) for i in range(12)] + [(90, None, page(90))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html_extract.content(d).collect()))
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, html_extract.content(d).collect())) == want


def test_wrapper_learns_a_late_layout(spark):
    rows = [(i, f"http://a.com/{i}", page(i) if i < 1800 else f'<aside class="new"><b>Banner</b><i>Late {i}.</i></aside>') for i in range(1900)]
    got = html_extract.content(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).where("page_id >= 1800").collect()
    assert all(r.content == f"Late {r.page_id}." and r.n_template == 1 for r in got)


def test_wrapper_counts_texts_exactly(spark):
    texts = [t for i in range(1000) if zlib.crc32((t := f"Word {i} of it.").encode()) > 1 << 31][:320]
    rows = [(i, f"http://a.com/{i}", f"<h1>Site</h1><p>{t}</p>") for i, t in enumerate(texts)]
    got = html_extract.content(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.content for r in got) == sorted(texts)


def test_wrapper_keeps_single_texts_of_a_slot(spark):
    rows = [(i, f"<h1>Site</h1><i>Ad {i % 5}</i><p>Text {i}.</p>") for i in range(60)]
    rows += [(i, f"<h1>Site</h1><i>Ad {i % 5}</i><p>Mirrored {i // 2}.</p>") for i in range(60, 90)]  # a third is there twice
    rows += [(90, "<h1>Site</h1><i>Only here</i><p>Text 90.</p>")]
    want = {i: h.rpartition("<p>")[2][:-4] for i, h in rows} | {90: "Only here\nText 90."}
    copies = [(i + 1000, h) for i, h in rows]  # identical pages are one
    for part in (rows, rows + copies):
        d = spark.createDataFrame([(i, "http://a.com/", h) for i, h in part], "page_id long, url string, html string")
        assert {r.page_id: r.content for r in html_extract.content(d).collect()} == {i: want[i % 1000] for i, _ in part}


def test_tree_matching_is_greatest():
    a, b = html_extract.parse("<ul><li>1</li><b>x</b><li>2</li></ul>"), html_extract.parse("<ul><b>x</b><li>2</li></ul>")
    assert html_extract.weight(a, b, {}) == 6
    assert html_extract.pairs(a[2][0][2], b[2][0][2], {}) == [(1, 0), (2, 1)]


def test_tree_matching_with_repeated_siblings():
    rng = random.Random(3)

    def some(depth):
        return [rng.choice(["section", "div", "ul"]), "", [some(depth - 1) for _ in range(rng.randrange(4))] if depth else [["#text", "", []]] * rng.randrange(2)]

    def size(x, y):
        return 1 + sum(size(x[2][i], y[2][j]) for i, j in html_extract.pairs(x[2], y[2], {}))

    def greatest(x, y):  # every way to match, without a shortcut
        if x[0] != y[0]:
            return 0
        best = [[0] * (len(y[2]) + 1) for _ in range(len(x[2]) + 1)]
        for i, a in enumerate(x[2]):
            for j, b in enumerate(y[2]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + greatest(a, b) if a[0] == b[0] else 0)
        return 1 + best[-1][-1]

    for _ in range(300):
        a, b = ["#root", "", [some(2) for _ in range(3)]], ["#root", "", [some(2) for _ in range(rng.choice([2, 3, 4]))]]
        assert size(a, b) == greatest(a, b)


def test_pipeline_runs_and_drops_what_it_should(spark, tmp_path):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline

    rng = random.Random(9)
    words = "the of and river stone light over under water wind house green".split()
    good = [" ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(50)) for _ in range(60)]
    junk = [" ".join(rng.choice(["a%%%", "b###", "c$$$"]) for _ in range(50)) for _ in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*good, *junk])]
    rows += [(200, good[0], "en", "s", 1), (201, good[1] + " tail", "en", "s", 1), (202, good[2] + " mail a.b@mail.example.com now", "en", "s", 1), (203, None, "en", "s", None), (204, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not got & set(range(60, 90)) and not got & {200, 201, 202} and set(range(60)) <= got and {203, 204} <= got
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns
