"""Main text of web pages by wrapper induction.

Each page becomes a DOM tree, in which a run of plain siblings of one tag and
class (paragraphs, items, cells, without blocks in them) is one node. Pages of one
host are aligned, one after the other, with the host's template by simple tree
matching: two nodes match if tag and class agree, children match in order so that
the number of matched nodes is greatest; nodes of a page that match nothing are
added, and none is taken out. Templates of parts of the table are merged by the
same alignment, in rounds, until there is one a host. Then each page is aligned
with its template, and Spark counts every text of every node by 64-bit hashes:
a text is the site's if it is on more than half of the pages that have its node (a
constant), or if it is on two or more and more than half of the node's texts are
such (one of some that rotate). All other text, also a single one among those that
repeat, is content.

Defined results: a null or empty html has null or empty content; a null url, or
a host with one page, has no template, so all visible text is content; a null id
is carried along; rows whose structure and texts are the same count as one page.
Pages that differ from a copy in some text are pages of their own: where they are
more than half of a host's, what they share is the site's. Script, style, head and comments are
never content. Rows that repeat are extracted each; a very long page is read whole,
and nodes more than DEPTH deep are children of the node at that depth, in order; of
matches that tie the one that leaves later nodes out is taken; an empty table gives no rows; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import BROADCAST_BYTES, cut, read

PIECE = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|title)\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*>", re.S | re.I)
CLASS = re.compile(r"\bclass\s*=\s*[\"']?([^\"'>]*)", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
FAN = 16
#: Hosts of which a task keeps a template at once.
HELD = 2000
DEPTH = 100
#: What can be in a run of like siblings that is kept as one node: text, its markup, items and cells.
INLINE = frozenset("#text a abbr b bdi bdo br cite code data dd del dfn dt em font i img input ins kbd label li mark option q s samp small span strong sub sup tbody td tfoot th thead time tr u var wbr".split())
#: Structures that a task keeps for a host; more are aligned again.
KEPT = 2000

TAG, TEXT, KIDS = range(3)


def parse(page: str) -> list:
    """The tree of a page as [tag and class, text, children]."""
    root = ["#root", "", []]
    stack, names, at = [root], ["#root"], 0

    def text(a: int, b: int) -> None:
        t = page[a:b]
        if t and not t.isspace():
            kids = stack[-1][KIDS]
            t = " ".join(html.unescape(t).split())
            kids.append(["#text", t, []])

    for m in PIECE.finditer(page):
        if m.start() > at:
            text(at, m.start())
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                if k:
                    del stack[k:], names[k:]
            continue
        if name in BLOCK and "p" in names:  # a block ends an open paragraph and what is open in it
            k = len(names) - 1 - names[::-1].index("p")
            del stack[k:], names[k:]
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and names[-1] == name:
            stack.pop(), names.pop()
        cls = CLASS.search(m[4]) if m[4] else None
        node = [f"{name}.{cls[1]}" if cls else name, "", []]
        stack[-1][KIDS].append(node)
        if name not in VOID and len(stack) < DEPTH and not m[0].endswith("/>"):
            stack.append(node)
            names.append(name)
    if at < len(page):
        text(at, len(page))
    return root


def weight(a: list, b: list, memo: dict) -> int:
    """Simple tree matching: the most nodes that match, parents with parents and in order."""
    if a[TAG] != b[TAG]:
        return 0
    x, y = a[KIDS], b[KIDS]
    if not x or not y:
        return 1
    if len(x) == 1 and len(y) == 1:
        return 1 + weight(x[0], y[0], memo)
    key = (id(a), id(b))
    got = memo.get(key)
    if got is None:
        got = memo[key] = 1 + _table(x, y, memo)[-1][-1]
    return got


def _table(x: list, y: list, memo: dict) -> list[list[int]]:
    rows = [[0] * (len(y) + 1)]
    plain = [len(b[KIDS]) == 1 and b[KIDS][0][TAG] == "#text" for b in y]
    tags = [b[TAG] for b in y]
    for a in x:
        prev, row, left, tag = rows[-1], [0], 0, a[TAG]
        flat = len(a[KIDS]) == 1 and a[KIDS][0][TAG] == "#text"
        for j, b in enumerate(y):
            best = 0 if tag != tags[j] else prev[j] + (2 if flat and plain[j] else weight(a, b, memo))
            up = prev[j + 1]
            left = best if best >= up and best >= left else (up if up > left else left)
            row.append(left)
        rows.append(row)
    return rows


def _flat(a: list, tag: str) -> bool:
    k = a[KIDS]
    return a[TAG] == tag and len(k) == 1 and k[0][TAG] == "#text"


def _alike(a: list, b: list) -> bool:
    """Whether no match of a or of b can be better than that of both."""
    return a[TAG] == b[TAG] and (not a[KIDS] and not b[KIDS] or _flat(a, a[TAG]) and _flat(b, b[TAG]))


def pairs(x: list, y: list, memo: dict) -> list[tuple[int, int]]:
    """Matched children, in order."""
    n, m = len(x), len(y)
    # leaves and plain nodes of one tag at both ends are in a best match
    lo = 0
    while lo < n and lo < m and _alike(x[lo], y[lo]):
        lo += 1
    hi = 0
    while hi < n - lo and hi < m - lo and _alike(x[n - 1 - hi], y[m - 1 - hi]):
        hi += 1
    out = [(i, i) for i in range(lo)]
    x_, y_ = x[lo : n - hi], y[lo : m - hi]
    if x_ and y_ and (tag := x_[0][TAG]) and all(_flat(k, tag) for k in x_) and all(_flat(k, tag) for k in y_):
        out += [(lo + i, lo + i) for i in range(min(len(x_), len(y_)))]  # all alike, so any order-keeping match is a best one
    elif x_ and y_:
        rows = _table(x_, y_, memo)
        i, j, mid = len(x_), len(y_), []
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                mid.append((lo + i, lo + j))
        out += mid[::-1]
    return out + [(n - hi + k, m - hi + k) for k in range(hi)]


def _union(a: list, b: list) -> None:
    """Adds plain node b to a."""
    if a[TAG] == "#text":
        a[TEXT] += b[TEXT]
    for k in b[KIDS]:
        for have in a[KIDS]:
            if have[TAG] == k[TAG]:
                _union(have, k)
                break
        else:
            a[KIDS].append(k)
            a[KIDS].sort(key=lambda x: x[TAG])


def fold(p: list, texts: list[str]) -> tuple[list, bool]:
    """(structure of a tree, whether all in it is INLINE); its texts go to texts, a text node has their numbers.

    A run of plain siblings of one tag and class is one node, and so are like nodes within a plain one, which are ordered by tag.
    """
    if p[TAG] == "#text":
        texts.append(p[TEXT])
        return ["#text", [len(texts) - 1], []], True
    out, all_plain, last = [], True, False
    for kid in p[KIDS]:
        f, plain = fold(kid, texts)
        if plain and last and out[-1][TAG] == f[TAG]:
            _union(out[-1], f)
        else:
            out.append(f)
        last = plain
        all_plain = all_plain and plain and f[TAG].partition(".")[0] in INLINE
    node = [p[TAG], None, out]
    if all_plain and out:
        node[KIDS] = []
        _union(node, [p[TAG], None, out])
    return node, all_plain


def key(p: list) -> str:
    """The structure of a folded tree."""
    if not p[KIDS]:
        return p[TAG]
    return f"{p[TAG]}({','.join(map(key, p[KIDS]))})"


def structure(page: str) -> tuple[list, list[str], str]:
    """(folded tree, texts in order, key) of a page."""
    texts: list[str] = []
    tree = fold(parse(page), texts)[0]
    return tree, texts, key(tree)


def merge(t: list, p: list, memo: dict | None = None) -> None:
    """Aligns p, a page or a template, with template t and adds it to t."""
    memo = {} if memo is None else memo
    old, i, j, out = t[KIDS], 0, 0, []
    matched = pairs(old, p[KIDS], memo)
    for a, b in [*matched, (len(old), len(p[KIDS]))]:
        out += old[i:a]
        out += p[KIDS][j:b]
        if a < len(old):
            merge(old[a], p[KIDS][b], memo)
            out.append(old[a])
        i, j = a + 1, b + 1
    t[KIDS] = out


def number(t: list, at: int = 0) -> int:
    """Numbers the nodes of a template in order; the next number."""
    t[TEXT] = at
    at += 1
    for k in t[KIDS]:
        at = number(k, at)
    return at


def slots(t: list, p: list, n: int) -> list[int]:
    """The number of the template's node for each of the n texts of a page, -1 for none."""
    out, memo = [-1] * n, {}

    def walk(t: list, p: list) -> None:
        if p[TAG] == "#text":
            for i in p[TEXT]:
                out[i] = t[TEXT]
        for a, b in pairs(t[KIDS], p[KIDS], memo):
            walk(t[KIDS][a], p[KIDS][b])

    walk(t, p)
    return out


def digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _host():
    return F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


PART = "host string, part long, template string"


def _pages(pages: DataFrame) -> DataFrame:
    host = _host()
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(host != "", host).alias("host"), "html")


def _learn(batches):
    from pyspark import TaskContext

    held: dict[str, tuple[list, set[int]]] = {}
    part = TaskContext.get().partitionId()

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([part] * len(held), pa.int64()), pa.array([json.dumps(t) for t, _ in held.values()], pa.string())], names=["host", "part", "template"])

    for b in batches:
        for host, page in zip(b["host"].to_pylist(), b["html"].to_pylist()):
            if host not in held and len(held) >= HELD:
                yield flush()
                held.clear()
            tree, _, form = structure(page)
            number(tree)
            if host not in held:
                held[host] = tree, {digest(form)}
                continue
            t, seen = held[host]
            if (d := digest(form)) not in seen:  # one of the same structure adds nothing
                merge(t, tree)
                if len(seen) < KEPT:
                    seen.add(d)
    if held:
        yield flush()


def _combine(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    first, *more = sorted(set(t["template"].to_pylist()))
    first = json.loads(first)
    for x in more:
        merge(first, json.loads(x))
    number(first)
    return pa.table([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int64()), pa.array([json.dumps(first)])], names=["host", "part", "template"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template) of every host, from all its pages."""
    parts = cut(_pages(pages).where("host IS NOT NULL AND html IS NOT NULL").select("host", "html").mapInArrow(_learn, PART))
    most = parts.agg(F.max("part")).first()[0]
    while most is not None:
        most //= FAN
        parts = parts.withColumn("to", F.expr(f"part div {FAN}")).groupBy("host", "to").applyInArrow(_combine, PART)
        if most == 0:
            break
        parts = cut(parts)
    return parts.groupBy("host").agg(F.first("template").alias("template"))


class Known:
    """A host's template and what of it is the site's."""

    def __init__(self, template: str, site):
        self.tree, self.kept, self.site = json.loads(template), {}, {x["node"]: set(x["texts"]) for x in site or ()}
        number(self.tree)

    def has(self, node: int, text: str) -> bool:
        """Whether this text of a node is the site's."""
        return node in self.site and digest(text) in self.site[node]

    def slots(self, tree: list, form: str, n: int) -> list[int]:
        """As of slots; the nodes of a structure met before are taken from there."""
        leaves: list[list[int]] = []

        def walk(p: list) -> None:
            if p[TAG] == "#text":
                leaves.append(p[TEXT])
            for k in p[KIDS]:
                walk(k)

        walk(tree)
        got = self.kept.get(form)
        if got is None:
            out = slots(self.tree, tree, n)
            if len(self.kept) < KEPT:
                self.kept[form] = [out[x[0]] for x in leaves]
            return out
        out = [-1] * n
        for x, node in zip(leaves, got):
            for i in x:
                out[i] = node
        return out


RESULT = "page_id long, host string, content string, n_content long, n_template long"


def _extracted(rows, find) -> pa.Table:
    cols: list[list] = [[], [], [], [], []]
    for page_id, host, page in rows:
        texts, every = [], []
        if page is not None:
            tree, every, form = structure(page)
            if (known := find(host)) is None:
                texts = every
            else:
                texts = [x for x, node in zip(every, known.slots(tree, form, len(every))) if not known.has(node, x)]
        for c, v in zip(cols, (page_id, host, None if page is None else "\n".join(texts), len(texts), len(every) - len(texts))):
            c.append(v)
    types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "host", "content", "n_content", "n_template"])


SEEN = "host string, page long, nodes array<int>, texts array<long>"


def _seen(rows, find) -> pa.Table:
    """For each page of a host a hash of it, and each (node, hash of text); a null text stands for any."""
    cols: list[list] = [[], [], [], []]
    for _, host, page in rows:
        if page is None or (known := find(host)) is None:
            continue
        tree, every, form = structure(page)
        has = sorted({(node, digest(x)) for x, node in zip(every, known.slots(tree, form, len(every))) if node >= 0})
        nodes = sorted({n for n, _ in has})
        for c, v in zip(cols, (host, digest("\0".join([form, *every])), [*nodes, *(n for n, _ in has)], [*[None] * len(nodes), *(x for _, x in has)])):
            c.append(v)
    types = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["host", "page", "nodes", "texts"])


def _with_templates(pages: DataFrame, known: DataFrame, work, schema: str) -> DataFrame:
    """work on all pages, each with what is known of its host: (host, template, site)."""
    rows = _pages(pages)
    if (known.agg(F.sum(F.octet_length("template") + F.coalesce(F.expr("aggregate(site, 0L, (n, x) -> n + 16 + 8 * size(x.texts))"), F.lit(0)))).first()[0] or 0) <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: (r.template, r.site) for r in known.collect()})

        def run(batches):
            ready: dict[str, Known | None] = {}

            def find(host):
                if host not in ready:
                    ready[host] = Known(*shared.value[host]) if host in shared.value else None
                return ready[host]

            for b in batches:
                yield from work(zip(*(b[c].to_pylist() for c in ("page_id", "host", "html"))), find).to_batches()

        return rows.mapInArrow(run, schema)

    def shuffled(left: pa.Table, right: pa.Table) -> pa.Table:
        t = Known(right["template"][0].as_py(), right["site"][0].as_py()) if right.num_rows else None
        return work(zip(*(left[c].to_pylist() for c in ("page_id", "host", "html"))), lambda host: t)

    # more templates than fit: pages go to their host's, those of a large host to several copies of it
    salts = rows.groupBy("host").agg(F.ceil(F.count("*") / 5000).cast("int").alias("salts"))
    keyed = rows.join(salts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.col("salts")).cast("int")).drop("salts")
    copies = known.join(salts, "host").select("host", "template", "site", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return keyed.groupBy("host", "salt").cogroup(copies.groupBy("host", "salt")).applyInArrow(shuffled, schema)


SITE = "array<struct<node:int,texts:array<long>>>"


def site(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(host, site) of the hosts of which some is the site's; every text of every different page is counted."""
    none = known.withColumn("site", F.lit(None).cast(SITE))
    once = _with_templates(pages, none, _seen, SEEN).groupBy("host", "page").agg(F.first("nodes").alias("nodes"), F.first("texts").alias("texts"))
    each = once.select("host", F.explode(F.arrays_zip("nodes", "texts")).alias("x")).select("host", F.col("x.nodes").alias("node"), F.col("x.texts").alias("text"))
    counts = each.groupBy("host", "node", "text").agg(F.count("*").alias("n"))
    again = "text IS NOT NULL AND n > 1"
    by = counts.groupBy("host", "node").agg(
        F.max(F.expr("if(text IS NULL, n, 0)")).alias("pages"),
        F.sum(F.expr("if(text IS NULL, 0, n)")).alias("all"),
        F.sum(F.expr(f"if({again}, n, 0)")).alias("repeated"),
        F.collect_list(F.expr(f"if({again}, struct(text, n), NULL)")).alias("x"),
    )
    found = by.select("host", "node", F.expr("transform(filter(x, t -> 2 * t.n > pages OR 2 * repeated > all), t -> t.text)").alias("texts")).where(F.size("texts") > 0)
    return found.groupBy("host").agg(F.collect_list(F.struct("node", "texts")).alias("site"))


def content(pages: DataFrame) -> DataFrame:
    """(page_id, host, content, n_content, n_template) of every page."""
    known = cut(templates(pages))
    return _with_templates(pages, cut(known.join(site(pages, known), "host", "left")), _extracted, RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    return content(read(spark, sf_dir, "pages"))
