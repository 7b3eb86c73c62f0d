"""Private data by weak supervision.

Broad patterns propose spans of five kinds: email, ip, card, phone, secret. Five
labelers vote on each (+1 private, -1 not, 0 abstain): strict regex, checksum or
shape, gazetteer (issuers, calling codes, top-level domains, key prefixes and
names), context words around, and isolation. Counts of vote patterns over all
documents go to expectation-maximisation, which estimates each labeler's
reliability and a posterior for each pattern; a logistic span classifier over
votes and character shape is trained on those posteriors and decides.

Every text is searched from its first to its last character, however long it is,
and no candidate has a greatest length.

Defined results: a null or empty text has no spans; a null id is carried along;
rows that repeat give their spans each; offsets count code points. Where two
kinds could begin at one place, the first of KINDS is taken; a probability of
exactly THRESHOLD is private. Other columns play no part in `detect`. With no candidates at all, as in an empty table,
the model keeps its prior, and nothing is redacted. `redact` returns all columns
of its input, whatever their names, with only text and n_chars changed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import cut, read

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("regex", "shape", "gazetteer", "context", "isolation")
THRESHOLD = 0.5
SHAPE_BUCKETS = 64
WINDOW = 48

PLAIN = r"""(?P<email>(?<![\w.+%-])[\w.+%-]++@[\w-]+(?:\.[\w-]+)*)
      | (?P<ip>(?<!\d)(?<!\d\.)\d{1,3}(?:\.\d{1,3}){3}(?!\d))
      | (?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))
      | (?P<phone>(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}|\d{3}[ .-]\d{3,4}[ .-]\d{4})(?!\d))
      | (?P<secret>(?:token|passw(?:or)?d|passwd|pwd|secret|api_?key|access_?key|auth)\w{0,16}\s{0,2}[=:]\s{0,2}["']?[^\s"']{8,}["']?
          | (?<![\w./+-])(?=[A-Za-z_-]*+\d)(?=[\d_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}(?![\w@]))"""
#: What any candidate begins with, tried first: a place after no sign of a run, or one of the signs that numbers and names of secrets begin with.
BEGIN = r"(?:(?<![\w.+-])|(?=[\d(+tpsa]))"
CANDIDATE = re.compile(f"{BEGIN}(?:{PLAIN})", re.X | re.I)
STRICT = {
    "email": re.compile(r"[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"),
    "ip": re.compile(r"(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}"),
    "card": re.compile(r"\d{13,19}|\d{4}([ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}"),
    "phone": re.compile(r"(\+\d{1,3}[ .-]?)?(\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])?\d{2,4}[ .-]\d{2,4}([ .-]\d{2,4})?|\+\d{8,15}"),
    "secret": re.compile(r"[\w.-]*(token|passw(or)?d|passwd|pwd|secret|key|auth)[\w.-]*\s*[=:]\s*[\"']?[^\s\"']{8,}[\"']?|(AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-|AIza)[\w-]{12,}", re.I),
}
DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch at be pl se no fi dk pt gr cz ie nz mx ar cl za kr tr example invalid test".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "64", "65", "81", "82", "86", "90", "91", "351", "353", "358", "420")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxa-", "xoxb-", "xoxp-", "AIza")
NAMES = re.compile(r"token|passw(or)?d|passwd|pwd|secret|api_?key|access_?key|auth", re.I)
CUES = {
    "email": re.compile(r"\b(e-?mail|mail|write|contact|correo|courriel|kontakt|schreib\w*)\b", re.I),
    "ip": re.compile(r"\b(ip|host|address|server|login|from|client|adresse|direcci[oó]n)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|credit|payment|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono|anruf\w*)\b", re.I),
    "secret": re.compile(r"\b(token|password|secret|key|credential\w*|login|clave|passwort)\b", re.I),
}
AGAINST = re.compile(r"\b(version|release|chapter|section|page|isbn|issn|doi|figure|table|volume|sha1|md5|commit|uuid|checksum)\W{0,3}$", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def shape(s: str) -> str:
    """Runs of digits, capitals and small letters by a sign each, others as they are."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", s)))


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    digits = re.sub(r"\D", "", span)
    value = re.split(r"[=:]\s*", span, maxsplit=1)[-1].strip("\"'") if kind == "secret" else span
    strict = 1 if STRICT[kind].fullmatch(span) else -1
    if kind == "email":
        local, _, domain = span.partition("@")
        form = 1 if local[0].isalnum() and "." in domain and ".." not in span else -1
        gaz = 1 if domain.rsplit(".", 1)[-1].lower() in DOMAINS else 0
    elif kind == "ip":
        parts = [int(x) for x in span.split(".")]
        form = 1 if all(x < 256 for x in parts) and not any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else -1
        gaz = -1 if parts[0] in (0, 127, 255) or sum(parts) < 12 else 1
    elif kind == "card":
        form = 1 if luhn(digits) else -1
        gaz = 1 if digits[0] in "3456" or digits[:4] in ("2221", "2720") else -1
    elif kind == "phone":
        form = 1 if 7 <= len(digits) <= 15 and re.search(r"[ ().+-]", span) else -1
        gaz = 1 if span[0] == "+" and digits.startswith(CALLING) else (1 if re.search(r"\(\d{2,4}\)", span) else 0)
    else:
        form = 1 if entropy(value) >= 2.8 and any(c.isdigit() for c in value) else -1
        gaz = 1 if value.startswith(PREFIXES) or NAMES.search(span[: len(span) - len(value)]) else 0
    ctx = -1 if AGAINST.search(before) else (1 if CUES[kind].search(before) or CUES[kind].search(after) else 0)
    alone = -1 if (before[-1:].isalnum() or after[:1].isalnum() or before[-1:] in ("/", "#", "_")) else 1
    return strict, form, gaz, ctx, alone


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, votes as of "+-0", shape) of every candidate."""
    out = []
    for m in CANDIDATE.finditer(text):
        s, e, kind = m.start(), m.end(), m.lastgroup
        v = votes(kind, m[0], text[max(0, s - WINDOW) : s], text[e : e + WINDOW])
        out.append((s, e, kind, "".join("-0+"[x + 1] for x in v), shape(m[0])))
    return out


@dataclass
class Model:
    prior: dict[str, float]
    reliability: dict[str, list[list[float]]]  # for each kind and labeler: P(vote right | it votes) when private, when not
    weights: np.ndarray

    def p(self, kind: str, vote: str, form: str) -> float:
        z = float(self.weights[features(kind, vote, form)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(kind: str, vote: str, form: str) -> list[int]:
    k = KINDS.index(kind)
    out = [0, 1 + k] + [6 + (k * len(LABELERS) + j) * 3 + "-0+".index(v) for j, v in enumerate(vote)]
    return [*out, 6 + 75 + zlib.crc32(f"{kind}:{form}".encode()) % SHAPE_BUCKETS]


def expectation_maximisation(counts: dict[str, int], rounds: int = 50) -> tuple[float, list[list[float]], dict[str, float]]:
    """(prior, accuracies of each labeler for both classes, posterior of each vote pattern); the counts are of one kind."""
    pats = sorted(counts)
    n = np.array([counts[p] for p in pats], float)
    v = np.array([["-0+".index(c) - 1 for c in p] for p in pats])
    prior, acc = 0.5, np.full((v.shape[1], 2), 0.8)
    post = np.full(len(pats), 0.5)
    for _ in range(rounds):
        a1, a0 = acc[:, 0], acc[:, 1]
        l1 = np.log(prior) + np.where(v > 0, np.log(a1), np.where(v < 0, np.log(1 - a1), 0)).sum(axis=1)
        l0 = np.log(1 - prior) + np.where(v < 0, np.log(a0), np.where(v > 0, np.log(1 - a0), 0)).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(l0 - l1, -50, 50)))
        w1, w0 = n * post, n * (1 - post)
        prior = float(np.clip((w1.sum() + 2) / (n.sum() + 4), 0.02, 0.98))
        for j in range(v.shape[1]):  # a Beta(8, 2) prior keeps labelers better than chance and both classes apart
            acc[j, 0] = np.clip((w1[v[:, j] > 0].sum() + 8) / (w1[v[:, j] != 0].sum() + 10), 0.55, 0.98)
            acc[j, 1] = np.clip((w0[v[:, j] < 0].sum() + 8) / (w0[v[:, j] != 0].sum() + 10), 0.55, 0.98)
    return prior, acc.tolist(), dict(zip(pats, post.tolist()))


def train_spans(rows: list[tuple[str, str, str, float]], post: dict[tuple[str, str], float], steps: int = 300) -> np.ndarray:
    """Weights of a logistic span classifier on (kind, votes, shape, weight) with EM's posteriors as soft labels."""
    w = np.zeros(6 + 75 + SHAPE_BUCKETS)
    if not rows:
        w[0] = -1.0
        return w
    x = np.array([features(k, v, s) for k, v, s, _ in rows])
    y = np.array([post[k, v] for k, v, _, _ in rows])
    c = np.array([n for *_, n in rows], float)
    c /= c.sum()
    rate = np.zeros_like(w) + 1e-8
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30))) - y) * c
        grad = np.bincount(x.reshape(-1), np.repeat(g, x.shape[1]), len(w)) + 1e-5 * w
        rate += grad * grad
        w -= 0.5 * grad / np.sqrt(rate)
    return w


CANDIDATES = "doc_id long, start int, end int, kind string, votes string, shape string"


def candidates(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(i, *x) for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for x in find(t)]
            cols = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "start", "end", "kind", "votes", "shape"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(run, CANDIDATES)


def fit(spans: DataFrame) -> Model:
    """EM over the counts of all vote patterns, then the span classifier. At most 3**5 patterns a kind, times SHAPE_BUCKETS, reach the driver."""
    by: dict[str, dict[str, int]] = {}
    for r in spans.groupBy("kind", "votes").count().collect():
        by.setdefault(r.kind, {})[r.votes] = r["count"]
    prior, rel, post = {}, {}, {}
    for kind, counts in by.items():
        prior[kind], rel[kind], p = expectation_maximisation(counts)
        post |= {(kind, v): x for v, x in p.items()}
    shapes = spans.groupBy("kind", "votes", "shape").count().withColumn("bucket", F.crc32(F.concat_ws(":", "kind", "shape").cast("binary")) % SHAPE_BUCKETS)
    rows = shapes.groupBy("kind", "votes", "bucket").agg(F.min("shape").alias("shape"), F.sum(F.sqrt("count")).alias("weight"))
    rows = rows.select("kind", "votes", "shape", "weight").orderBy("kind", "votes", "bucket").collect()
    return Model(prior, rel, train_spans([tuple(r) for r in rows], post))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind, p) of every span taken for private."""
    spans = cut(candidates(docs))
    model = fit(spans)

    def run(batches):
        for b in batches:
            p = [round(model.p(*x), 6) for x in zip(*(b[n].to_pylist() for n in ("kind", "votes", "shape")))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["start"], b["end"], b["kind"], pa.array(p, pa.float64())], names=["doc_id", "start", "end", "kind", "p"])

    return spans.mapInArrow(run, "doc_id long, start int, end int, kind string, p double").where(F.col("p") >= THRESHOLD)


def redact_text(text: str, model: Model) -> str:
    out, at = [], 0
    for s, e, kind, v, form in find(text):
        if model.p(kind, v, form) >= THRESHOLD:
            out += [text[at:s], f"<{kind.upper()}>"]
            at = e
    return "".join([*out, text[at:]]) if at else text


def redact(docs: DataFrame) -> DataFrame:
    """docs with each private span replaced by its kind; n_chars, if there, follows the text."""
    model = fit(cut(candidates(docs)))

    def run(batches):
        for b in batches:
            texts = [t if t is None else redact_text(t, model) for t in b["text"].to_pylist()]
            cols = [pa.array(texts, f.type) if f.name == "text" else c for f, c in zip(b.schema, b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
