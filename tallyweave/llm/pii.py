"""Personal data by weak supervision.

Wide patterns give candidate spans; five labelers (shape, gazetteer, context, boundary, variety) each
vote yes, no or nothing on a candidate. Expectation-maximisation over the counts of vote patterns of all
candidates estimates how reliable each labeler is for each kind, which gives every pattern a chance of
being personal data. With these as soft labels a logistic span classifier is trained that does not see
the votes but the span and its neighbourhood: its shape, length, digits and variety, the words before and
after it and the signs at its edges. Spans of the base patterns always stay; the classifier adds further
ones that overlap no base span.

The first pass sends only counts by vote pattern (at most a few thousand codes, whatever the input) to
the driver, the second a sample of about ``FIT_SPANS`` candidates (at most twice as many), spread evenly over the kinds by a
hash, and the third finds and decides. Nothing is joined.

Defined cases: null text is empty; documents without spans give zero counts and the hash of the empty
text; repeated rows are scored each on its own; without any candidate the
classifier accepts nothing; an empty table gives an empty result; other columns are carried only by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "number", "local_phone", "hidden_email", "secret")
LABELERS = ("shape", "gazetteer", "context", "boundary", "variety")

_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, so starts inside a run are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_HIDDEN = re.compile(r"[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,64}(?: ?[\[(]dot[\])] ?[A-Za-z]{2,24})+", re.I)
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(token|secret|password|passwd|api_?key|key)( ?[=:] ?)([\"']?)([A-Za-z0-9_+/-]{16,})\3", re.I)
_DIGIT = re.compile(r"[0-9]")
_CUES = {
    "email": r"mail|contact|write|reach", "ip": r"\bip\b|address|server|host|addr", "card": r"card|visa|master|credit|payment|account",
    "phone": r"phone|call|tel\b|mobile|fax|contact", "number": r"account|iban|ssn|passport|card|id\b", "local_phone": r"phone|call|tel\b|mobile|fax|contact",
    "hidden_email": r"mail|contact|write|reach", "secret": r"token|secret|password|key",
}
_CUE = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_AGAINST = re.compile(r"version|chapter|page|section|isbn|figure|\bv\b|licen[cs]e", re.I)
_TLDS = frozenset("com org net edu gov mil int info biz io de fr es it uk us eu ch at nl be pl pt ru cn jp kr in br mx ca au example test".split())
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[0-9]|6[0245]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def _emails(text: str) -> list[tuple[int, int, int]]:
    """Leftmost non-overlapping addresses, found outwards from each at sign, in linear time."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_PART:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    found = _emails(text)
    if _DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def wide_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base spans, none overlapping them or one another."""
    found = []
    if _DIGIT.search(text):
        found += [(4, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 9 and 9 <= len(_digits(m[0])) <= 34]
        found += [(5, m.start(), m.end()) for m in _LOCAL.finditer(text)]
        found += [(7, m.start(4), m.end(4)) for m in _SECRET.finditer(text)]
    if "at)" in (low := text.lower()) or "at]" in low:
        found += [(6, m.start(), m.end()) for m in _HIDDEN.finditer(text)]
    if not found:
        return found
    taken = sorted((s, e) for _, s, e in base)
    kept, starts = [], [s for s, _ in taken]
    at = np.array(starts or [0])
    ends = np.maximum.accumulate(np.array([e for _, e in taken] or [0]))
    last = -1
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], -x[0])):
        before = int(np.searchsorted(at, e, "left")) if taken else 0
        if s >= last and not (before and ends[before - 1] > s):
            kept.append((kind, s, e))
            last = e
    return sorted(kept)


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """One vote (1 yes, -1 no, 0 nothing) of each labeler."""
    name, span, digits = KINDS[kind], text[start:end], _digits(text[start:end])
    before, after = text[max(0, start - 32) : start], text[end : end + 1]
    if name in ("card", "number"):
        shape = 1 if 16 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if 15 <= len(digits) <= 19 and _ISSUERS.match(digits) else -1
    elif name == "email":
        tld = span.rpartition(".")[2].lower()
        shape, gazetteer = (1 if tld.isalpha() else -1), (1 if tld in _TLDS else 0)
    elif name == "ip":
        first = int(span.split(".")[0].lstrip("0") or 0)
        shape, gazetteer = (-1 if any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else 1), (-1 if first in (0, 127) or first > 239 else 1)
    elif name in ("phone", "local_phone"):
        shape, gazetteer = (1 if len(digits) >= 10 else 0), (1 if digits[0] != "0" else 0)
    elif name == "secret":
        shape = 1 if any(c.isdigit() for c in span) and any(c.isalpha() for c in span) else -1
        gazetteer = 1 if re.fullmatch(r"[0-9a-f]{32,}", span) else 0
    else:
        shape, gazetteer = 1, (1 if span.lower().rstrip(")] ").rpartition(" ")[2].strip("([") in _TLDS else 0)
    context = -1 if _AGAINST.search(before) else 1 if _CUE[name].search(before) else 0
    edge = before[-1:] + after
    boundary = -1 if any(c.isalnum() or c in "_/\\" for c in edge) else 1
    seen = set(digits or span)
    variety = -1 if len(seen) <= 2 else 1 if len(seen) >= 4 else 0
    return shape, gazetteer, context, boundary, variety


def _bucket(n: int) -> int:
    return 0 if n < 12 else 1 if n < 18 else 2 if n < 30 else 3


def code_of(kind: int, vote: tuple[int, ...], length: int) -> int:
    code = kind
    for v in vote:
        code = code * 3 + v + 1
    return code * 4 + _bucket(length)


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (0, 1, 2) and length bucket of each code."""
    bucket, rest = codes % 4, codes // 4
    vote = np.empty((len(codes), len(LABELERS)), np.int64)
    for i in reversed(range(len(LABELERS))):
        vote[:, i], rest = rest % 3, rest // 3
    return rest, vote, bucket


def estimate(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of "personal data" for each pattern, and the labelers' tables [kind, labeler, class, vote].

    Two-class confusion tables for each kind by expectation-maximisation. Prior pseudo-counts say that
    a labeler that votes is right more often than not, which also fixes which class is which.
    """
    prior = np.array([[6.0, 2.0, 2.0], [2.0, 2.0, 6.0]])  # class by vote (no, nothing, yes)
    post = np.clip(0.5 + 0.15 * (vote - 1).sum(1), 0.05, 0.95)
    table = np.tile(prior / prior.sum(1, keepdims=True), (len(KINDS), len(LABELERS), 1, 1))
    for _ in range(rounds):
        for k in np.unique(kind):
            at = kind == k
            share = (1 + (n[at] * post[at]).sum()) / (2 + n[at].sum())
            logit = np.full(at.sum(), np.log(share / (1 - share)))
            for i in range(len(LABELERS)):
                t = prior.copy()
                np.add.at(t[1], vote[at, i], n[at] * post[at])
                np.add.at(t[0], vote[at, i], n[at] * (1 - post[at]))
                table[k, i] = t / t.sum(1, keepdims=True)
                logit += np.log(table[k, i, 1, vote[at, i]] / table[k, i, 0, vote[at, i]])
            post[at] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, table


#: Candidates in the sample that the classifier is trained on.
FIT_SPANS = 20_000
#: Hashed features of spans.
BUCKETS = 1 << 12
_RUNS = [(re.compile("[0-9]+"), "0"), (re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A")]
_NEAR = re.compile(r"[^\W\d_]+")


def span_features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Buckets of what a span and its neighbourhood look like, in order, each once."""
    span, shape = text[start:end], text[start:end]
    for pattern, sign in _RUNS:
        shape = pattern.sub(sign, shape)
    shape = f"^{shape}$"
    digits = sum(c.isdigit() for c in span)
    names = [f"gram {shape[i : i + 3]}" for i in range(len(shape) - 2)]
    names += [f"length {min(len(span), 8191).bit_length()}", f"digits {min(digits, 40)}", f"share {4 * digits // len(span)}", f"variety {min(len(set(span)), 16)}"]
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    names += [f"before {w}" for w in _NEAR.findall(before.lower())[-3:]] + [f"after {w}" for w in _NEAR.findall(after.lower())[:1]]
    names += [f"left {before[-1:].isalnum()} {before[-1:]}", f"right {after[:1].isalnum()} {after[:1]}", "any"]
    return sorted({crc32(f"{KINDS[kind]} {x}".encode("utf-8", "surrogatepass")) % BUCKETS for x in names})


@dataclass
class SpanModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = -1.0
    threshold: float = 0.5

    def chance(self, text: str, kind: int, start: int, end: int) -> float:
        z = self.bias + self.weights[span_features(text, kind, start, end)].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def accepts(self, text: str, kind: int, start: int, end: int) -> bool:
        return self.chance(text, kind, start, end) >= self.threshold


def gradient(features: list[list[int]], soft: np.ndarray, w: np.ndarray, bias: float, ridge: float) -> tuple[np.ndarray, float]:
    """Of the summed log-loss of soft labels with a ridge on the weights."""
    row, col = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate([np.zeros(0, np.int64), *features]).astype(np.int64)
    p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(row, weights=w[col], minlength=len(features)), -30, 30)))
    return np.bincount(col, weights=(p - soft)[row], minlength=len(w)) + ridge * w, float((p - soft).sum())


def train(features: list[list[int]], soft: np.ndarray, ridge: float = 0.1, rounds: int = 300, rate: float = 0.3) -> SpanModel:
    """Logistic regression by Adagrad over the whole sample."""
    if not len(features):
        return SpanModel()
    w, bias, g2, b2 = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(rounds):
        g, b = gradient(features, soft, w, bias, ridge)
        g2, b2 = g2 + g * g, b2 + b * b
        w, bias = w - rate * g / np.sqrt(g2), bias - rate * b / np.sqrt(b2)
    return SpanModel(w, float(bias))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[int] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                base = base_spans(text)
                for kind, s, e in [*base, *wide_spans(text, base)]:
                    counts[code_of(kind, votes(text, kind, s, e), e - s)] += 1
    yield pa.RecordBatch.from_pydict({"code": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def fit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fit_spans: int = FIT_SPANS) -> SpanModel:
    """The classifier of candidate spans, trained on these documents."""
    bounded_batches(docs.sparkSession)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_count_batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code")
    rows = counted.collect()  # at most kinds x 3^labelers x 4 codes
    codes, n = np.array([r["code"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64)
    if not len(codes):
        return SpanModel()
    kind, vote, _ = _features(codes)
    post, _ = estimate(kind, vote, n.astype(float))
    chance = dict(zip(codes.tolist(), post.tolist(), strict=True))
    each = max(1, fit_spans // len(np.unique(kind)))
    limits = {int(k): min(1.0, 1.2 * each / n[kind == k].sum()) for k in np.unique(kind)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, list[int]]] = []
            for seed, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    base = base_spans(t)
                    for k, s, e in [*base, *wide_spans(t, base)]:
                        h = crc32(f"{seed} {k} {s}".encode())
                        if h < limits[k] * 2**32:
                            out.append((h, code_of(k, votes(t, k, s, e), e - s), span_features(t, k, s, e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["h", "code", "f"])

    seeded = docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.lit(17)).alias("seed"), F.col(text).alias("text"))
    # rows that repeat share a hash, so the limit bounds what the driver gets
    sample = seeded.mapInArrow(run, "h long, code long, f array<int>").orderBy("h", "code", "f").limit(2 * fit_spans).toArrow().to_pylist()
    return train([x["f"] for x in sample], np.array([chance[x["code"]] for x in sample]))


def decide(text: str, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; both by kind, then start."""
    base = base_spans(text)
    return base, sorted([*base, *(x for x in wide_spans(text, base) if model.accepts(text, *x))])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """doc_id, the counts of base spans, the hash of their list and all spans, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, spans = [], [], []
            for t in batch.column(1).to_pylist():
                base, every = decide(t or "", model)
                counts.append([sum(k == i for k, _, _ in base) for i in range(len(BASE))])
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns, pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; all columns and null texts stay."""
    schema, place = docs.schema, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column(place).to_pylist():
                if t:
                    out, at = [], 0
                    for s, e, k in sorted((s, e, k) for k, s, e in decide(t, model)[1]):
                        if s >= at:
                            out += [t[at:s], f"<{KINDS[k]}>"]
                        at = max(at, e)
                    t = "".join([*out, t[at:]]) if out else t
                texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_spans(docs, fit(docs))


QUERIES = {"op9_pii": op9_pii}
ORACLE_SQL: dict[str, str] = {}
