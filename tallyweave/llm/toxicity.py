"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's chance of being toxic is a logistic function of its
hashed words and word beginnings; the document's is the noisy-or of its sentences. Weights are
trained from document labels alone, with a sparsity penalty, and then locate the offending
sentences in any text. Scores out of fold fix the decision scale.

Features and weights are learned on about ``fit_rows`` labelled rows, drawn by a hash of the id; the
sample ends in the order of the hashes at ``fit_pairs`` pairs of a sentence and a kept feature, and every
row in it has all its sentences. What is broadcast is the ids of the sample, then one weight for each kept
feature, of which there are at most 2 ** ``bits``.

Defined cases: null and empty texts have no sentence and get the score of an empty bag; without
any toxic label every score is that of an empty bag; repeated rows are scored each on its own; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut, read_table

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
#: What all sentences without weighted features of a text add to the noisy-or, whatever their number.
FLOOR = 0.01


@dataclass(frozen=True)
class ToxicSpec:
    bits: int = 22
    fit_rows: int = 12000
    fit_pairs: int = 1 << 23
    epochs: int = 400
    l1: float = 0.05
    pull: float = 0.5
    rate: float = 0.2
    bias: float = -5.0


def word_features(word: str, bits: int = 22) -> list[int]:
    """Hash of the word and of its beginnings of four to eight letters."""
    top = (1 << bits) - 1
    found = [crc32(word.encode("utf-8", "surrogatepass")) & top]
    found += [crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) & top for n in range(4, min(8, len(word) - 1) + 1)]
    return found


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each stretch between sentence ends and line breaks."""
    return [(m.start(), m.end()) for m in _SENTENCE.finditer(text)]


@dataclass
class ToxicModel:
    weights: dict[int, float]  # feature -> weight, above zero
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    bits: int = 22

    def __post_init__(self) -> None:
        self._cache: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._cache = {}

    def _kept(self, word: str) -> tuple[int, ...]:
        found = self._cache.get(word)
        if found is None:
            if len(self._cache) >= 1 << 18:  # a bound on memory only; the value is the same
                self._cache.clear()
            found = self._cache[word] = tuple(f for f in word_features(word, self.bits) if f in self.weights)
        return found

    def suspects(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and log-odds of each sentence that holds a weighted feature; the others have the bias."""
        out, kept = [], self._kept
        for m in _SENTENCE.finditer(text):
            found: set[int] = set()
            for w in set(_WORD.findall(m[0].lower())):
                if f := kept(w):
                    found.update(f)
            if found:
                out.append((m.start(), m.end(), self.bias + sum(self.weights[f] for f in sorted(found))))
        return out

    def chance(self, none: float) -> float:
        """Calibrated chance from minus the log of the chance that no sentence is toxic."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * log_odds(none) + self.shift, -30, 30))))

    def score(self, text: str | None) -> float:
        return self.chance(sum(float(np.logaddexp(0.0, z)) for _, _, z in self.suspects(text or "")))


def log_odds(none: float) -> float:
    return float(np.log(np.expm1(min(none + FLOOR, 30.0))))


def _bags(text: str | None, bits: int) -> list[list[int]]:
    return [sorted({f for w in set(_WORD.findall(m[0].lower())) for f in word_features(w, bits)}) for m in _SENTENCE.finditer(text or "")]


def feature_counts(docs: DataFrame, bits: int) -> DataFrame:
    """feature, n and pos over the labelled rows (y, text): document frequencies in all and in toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                idx = np.array(sorted({f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w, bits)}), np.int64)
                n[idx] += 1
                if y:
                    pos[idx] += 1
        idx = n.nonzero()[0]
        for at in range(0, len(idx), 1 << 16):
            part = idx[at : at + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.int64()), "n": pa.array(n[part].astype(np.int64)), "pos": pa.array(pos[part].astype(np.int64))})

    return docs.select("y", "text").mapInArrow(run, "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def train(docs: DataFrame, labels: DataFrame, spec: ToxicSpec = ToxicSpec(), label: str = "toxic") -> ToxicModel:
    """``docs``: doc_id and text; ``labels``: doc_id and label of the rows to learn from."""
    docs = docs.select("doc_id", "text")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    there, size = known.count(), 1 << 30
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(size))
    picked = known.select("doc_id", "y", h.alias("h")).where(F.col("h") < int(min(1.0, spec.fit_rows / max(there, 1)) * size))
    # about fit_rows ids at any size of the table, so they can be broadcast and no text is shuffled
    rows = cut(docs.join(F.broadcast(picked), "doc_id").select("h", "y", "text"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_all = totals.get(1, 0), sum(totals.values())
    prior = (n_pos + 0.5) / (n_all + 1)
    blank = ToxicModel({}, spec.bias, 0.0, float(np.log(prior / (1 - prior))), spec.bits)
    if not n_pos or n_pos == n_all:
        return blank
    counts = cut(feature_counts(rows, spec.bits))
    many = counts.count()
    # twice the log-likelihood ratio of "more often in toxic rows" must stand out of all the features
    rate, n, pos = F.lit(n_pos / n_all), F.col("n"), F.col("pos")
    neg = n - pos
    ratio = pos * F.log(pos / (n * rate)) + F.when(neg > 0, neg * F.log(neg / (n * (1 - rate)))).otherwise(0.0)
    telling = counts.where((pos >= 3) & (pos > n * rate)).withColumn("e", ratio).where(F.col("e") > float(np.log(max(many, 2))))
    kept = telling.orderBy("feature").toArrow()
    index = kept["feature"].to_numpy()
    if not len(index):
        return blank
    pos_n, neg_n = kept["pos"].to_numpy(), kept["n"].to_numpy() - kept["pos"].to_numpy()
    prior_w = np.log((pos_n + 0.5) / (n_pos + 1)) - np.log((neg_n + 0.5) / (n_all - n_pos + 1))
    prior_w = np.maximum(prior_w - np.sqrt(1 / (pos_n + 0.5) + 1 / (neg_n + 0.5)), 0.0)
    rank = np.full(1 << spec.bits, -1, np.int32)
    rank[index] = np.arange(len(index))
    held = docs.sparkSession.sparkContext.broadcast(rank)
    bits = spec.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        for batch in batches:
            sent, feat = [], []
            for text in batch.column(2).to_pylist():
                pairs = [(i, int(at[f])) for i, bag in enumerate(_bags(text, bits)) for f in bag if at[f] >= 0]
                sent.append([i for i, _ in pairs])
                feat.append([f for _, f in pairs])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sent, pa.list_(pa.int32())), pa.array(feat, pa.list_(pa.int32()))], names=["h", "y", "s", "f"])

    found = cut(rows.mapInArrow(run, "h long, y int, s array<int>, f array<int>"))
    table = _within(found, spec.fit_pairs).toArrow()
    order = np.lexsort((table["y"].to_numpy(), table["h"].to_numpy()))
    y = table["y"].to_numpy()[order].astype(float)
    s, f = table["s"].combine_chunks(), table["f"].combine_chunks()
    bags = [(s[int(i)].values.to_numpy(), f[int(i)].values.to_numpy()) for i in order]
    weights = fit_noisy_or(bags, y, prior_w, spec)
    slope, shift = calibrate(bags, y, prior_w, spec)
    return ToxicModel({int(index[i]): float(weights[i]) for i in np.flatnonzero(weights > 1e-3)}, spec.bias, slope, shift, spec.bits)


def _within(found: DataFrame, most: int) -> DataFrame:
    """The rows of ``found`` (h, f) that come before a limit on all their pairs, in the order of ``h``.

    The pairs are summed by 4,096 equal ranges of the hash, so nothing is sorted in one place.
    """
    slot = F.col("h").bitwiseAND((1 << 30) - 1) % 4096
    total, stop = 0, 4096
    for r in found.groupBy(slot.alias("slot")).agg(F.sum(F.size("f")).alias("n")).orderBy("slot").collect():
        total += r["n"]
        if total > most:
            stop = max(1, r["slot"])
            break
    return found.where(slot < stop)


Bag = tuple[np.ndarray, np.ndarray]  # sentence and feature of each pair, by sentence


def _flat(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Document of each sentence, sentence and feature of each pair, number of sentences."""
    none = np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bags)), [len(s) for s, _ in bags])
    sent, feat = (np.concatenate([none, *(b[i] for b in bags)]).astype(np.int64) for i in range(2))
    if not len(row):
        return none, none, none, 0
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (sent[1:] != sent[:-1])))
    return row[new], np.cumsum(new) - 1, feat, int(new.sum())


def fit_noisy_or(bags: list[Bag], y: np.ndarray, prior: np.ndarray, spec: ToxicSpec) -> np.ndarray:
    """Proximal Adagrad on the noisy-or likelihood; weights stay non-negative and are drawn to ``prior``,
    the bound below each feature's log ratio, so a word that others explain away keeps its weight."""
    flat = _flat(bags)
    w, g2 = prior.copy(), np.full(len(prior), 1e-8)
    for _ in range(spec.epochs):
        g = gradient(flat, y, w, prior, spec)
        g2 += g * g
        w = np.maximum(0.0, w - spec.rate / np.sqrt(g2) * (g + spec.l1 / len(y)))
    return w


def gradient(flat: tuple[np.ndarray, np.ndarray, np.ndarray, int], y: np.ndarray, w: np.ndarray, prior: np.ndarray, spec: ToxicSpec) -> np.ndarray:
    """Of the mean noisy-or log-loss and of the pull to the prior."""
    doc, sent, feat, many = flat
    n = len(y)
    z = spec.bias + np.bincount(sent, weights=w[feat], minlength=many)
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    none = np.bincount(doc, weights=np.logaddexp(0.0, z), minlength=n) + FLOOR
    # d loss / d none of -y log(1 - e^-none) + (1 - y) none
    d = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(none, 50.0)), 1e-9), 1.0) / n
    return np.bincount(feat, weights=(d[doc] * p)[sent], minlength=len(w)) + spec.pull * (w - prior) / n


def calibrate(bags: list[Bag], y: np.ndarray, prior: np.ndarray, spec: ToxicSpec, folds: int = 4) -> tuple[float, float]:
    """Slope and shift of a logistic fit of the labels on log-odds that were scored out of fold."""
    at, x = np.arange(len(y)) % folds, np.zeros(len(y))
    for fold in range(folds):
        w = fit_noisy_or([bags[i] for i in np.flatnonzero(at != fold)], y[at != fold], prior, spec)
        rows = np.flatnonzero(at == fold)
        doc, sent, feat, many = _flat([bags[i] for i in rows])
        z = spec.bias + np.bincount(sent, weights=w[feat], minlength=many)
        hit = np.zeros(many, bool)
        hit[sent[w[feat] > 1e-3]] = True
        none = np.bincount(doc, weights=np.where(hit, np.logaddexp(0.0, z), 0.0), minlength=len(rows))
        x[rows] = [log_odds(v) for v in none]
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, v = np.array([((p - y) * x).sum() + 1e-2 * (a - 1), (p - y).sum()]), p * (1 - p) + 1e-9
        h = np.array([[(v * x * x).sum() + 1e-2, (v * x).sum()], [(v * x).sum(), v.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
    return max(a, 0.05), b


def attach(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score and the sentence of highest chance (start, end; null without one) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            scores, starts, ends = [], [], []
            for text in batch.column(1).to_pylist():
                found = m.suspects(text or "")
                top = max(found, key=lambda x: (x[2], -x[0]), default=(None, None, 0.0))
                scores.append(m.chance(sum(float(np.logaddexp(0.0, z)) for _, _, z in found)))
                starts.append(top[0])
                ends.append(top[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "score", "worst_start", "worst_end"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, worst_start long, worst_end long")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return attach(docs, model).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), "worst_start", "worst_end")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict[str, str] = {}
