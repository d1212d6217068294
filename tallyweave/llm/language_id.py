"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed 1- to 3-grams are counted over all learning rows. The model is
trained by follow-the-regularised-leader with an elastic net on at most ``fit_rows`` of them (and
``fit_terms`` distinct n-grams of rows in all), drawn by a hash of the id and spread over the languages,
each with all its n-grams, and a temperature is then fitted on rows that the
weights never saw. The weights go to the executors as one array of fixed size.

The term frequency of an n-gram is its share of the text's n-grams, so the scores of a text are the
mean over its n-grams of weight times inverse document frequency: one lookup and one mean, over the
whole text, in memory proportional to a block of it.

Defined cases: null text and texts without letters are ``und`` with score 0; without any learning
row every text is ``und``; rows with null text or null language are not learned from; repeated rows
are scored each on its own; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, read_table
from .ngrams import char_ngrams

#: Texts are read in blocks of so many characters, which bounds the memory that one text takes.
BLOCK = 1 << 16


@dataclass(frozen=True)
class LanguageSpec:
    bits: int = 16
    #: The fitting sample ends, in the order of the ids' hashes, at so many rows or distinct n-grams in all.
    fit_rows: int = 3000
    fit_terms: int = 1 << 23
    #: More languages than this are an error, since each takes a column of the broadcast weights.
    max_languages: int = 1024
    epochs: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    scale: float = 40.0


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # [bucket, language]: weight times inverse document frequency
    bias: np.ndarray
    temperature: float
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return "und", 0.0
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), BLOCK):
            idx = char_ngrams(text[at : at + BLOCK], self.bits)
            total += self.table.take(idx, axis=0).sum(0, dtype=np.float64)
            n += len(idx)
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def text_terms(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares."""
    counts = np.zeros(1 << bits, np.int64)
    for at in range(0, len(text), BLOCK):
        counts += np.bincount(char_ngrams(text[at : at + BLOCK], bits), minlength=1 << bits)
    idx = counts.nonzero()[0]
    return idx, counts[idx] / counts.sum()


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, over all rows; each task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = np.zeros(1 << bits, bool)
                for at in range(0, len(text), BLOCK):
                    seen[char_ngrams(text[at : at + BLOCK], bits)] = True
                df += seen
                rows += 1
        idx = df.nonzero()[0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(idx, -1), pa.int64()), "n": pa.array(np.append(df[idx], rows), pa.int64())})

    summed = docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(1 << bits)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, spec: LanguageSpec, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with per-coordinate rates over the rows' sparse features; weights and bias."""
    z, n = np.zeros((1 << spec.bits, k)), np.zeros((1 << spec.bits, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solved(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((spec.beta + np.sqrt(n)) / spec.alpha + spec.l2))

    order = np.random.default_rng(seed)
    for _ in range(spec.epochs):
        for i in order.permutation(len(rows)):
            idx, x = rows[i]
            w, b = solved(z[idx], n[idx], spec.l1), solved(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            rate = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / spec.alpha
            z[idx] += g - rate * w
            n[idx] += g * g
            rate = (np.sqrt(nb + p * p) - np.sqrt(nb)) / spec.alpha
            zb += p - rate * b
            nb += p * p
    return solved(z, n, spec.l1), solved(zb, nb, 0.0)


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log-loss, on a grid."""
    best, chosen = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 81):
        z = scores / t
        z = z - z.max(1, keepdims=True)
        loss = -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean()
        if loss < best:
            best, chosen = loss, float(t)
    return chosen


def train(docs: DataFrame, spec: LanguageSpec = LanguageSpec()) -> LanguageModel:
    """``docs``: doc_id, text and lang of the rows that may be learned from."""
    docs = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = docs.groupBy("lang").count().orderBy("lang").limit(spec.max_languages + 1).collect()
    if len(counts) > spec.max_languages:
        raise ValueError(f"more than {spec.max_languages} languages; raise max_languages")
    languages = [r["lang"] for r in counts]
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0), 1.0, spec.bits)
    df, n = document_frequencies(docs.select("text"), spec.bits)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = fit_sample(docs, {r["lang"]: r["count"] for r in counts}, spec)
    rows, y, doc = [], [], []
    for lang, h, idx, tf in sample:
        idx = np.asarray(idx, np.int64)
        rows.append((idx, np.asarray(tf, float) * idf[idx] * spec.scale))
        y.append(languages.index(lang))
        doc.append(h)
    y = np.array(y)
    held = np.array([h % 5 == 0 for h in doc])
    if held.all() or not held.any():
        held = np.zeros(len(y), bool)
    w, b = ftrl([rows[i] for i in np.flatnonzero(~held)], y[~held], len(languages), spec)
    check = np.flatnonzero(held) if held.any() else np.arange(len(y))
    scores = np.array([x @ w[idx] + b for idx, x in (rows[i] for i in check)])
    table = (w * (idf * spec.scale)[:, None]).astype(np.float32)
    return LanguageModel(languages, table, b, fit_temperature(scores, y[check]), spec.bits)


def fit_sample(docs: DataFrame, counts: dict[str, int], spec: LanguageSpec) -> list[tuple[str, int, list[int], list[float]]]:
    """At most ``fit_rows`` rows, spread evenly over the languages by a threshold on a hash of the id and
    cut in the order of the hashes; (language, hash, buckets, shares) by hash."""
    each = max(1, spec.fit_rows // len(counts))
    size = 1 << 30
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(size))
    keep = F.lit(False)
    for lang, n in counts.items():
        keep = keep | ((F.col("lang") == lang) & (h < int(min(1.0, 1.2 * each / n) * size)))
    bits = spec.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idxs, tfs = [], []
            for text in batch.column(2).to_pylist():
                idx, tf = text_terms(text, bits)
                idxs.append(idx.astype(np.int32))
                tfs.append(tf.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idxs, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.float32()))], names=["lang", "h", "idx", "tf"])

    picked = docs.where(keep).select("lang", h.alias("h"), "text").mapInArrow(run, "lang string, h long, idx array<int>, tf array<float>")
    # windows over the sample alone, whose rows are bounded
    by = Window.partitionBy("lang").orderBy("h")
    ranked = picked.select("*", F.row_number().over(by).alias("r"), F.sum(F.size("idx")).over(by).alias("terms"))
    few = max(1, spec.fit_terms // len(counts))
    table = ranked.where((F.col("r") <= each) & ((F.col("terms") <= few) | (F.col("r") == 1))).select("lang", "h", "idx", "tf").toArrow()
    langs, hs = table["lang"].to_pylist(), table["h"].to_numpy()
    idx, tf = table["idx"].combine_chunks(), table["tf"].combine_chunks()
    order = sorted(range(len(langs)), key=lambda i: (int(hs[i]), langs[i]))
    return [(langs[i], int(hs[i]), idx[i].values.to_numpy(), tf[i].values.to_numpy()) for i in order]


def predict(docs: DataFrame, model: LanguageModel, keep: tuple[str | Column, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, lang_pred and score of every row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            found = [m.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    done = predict(docs, model)
    return done.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE_SQL: dict[str, str] = {}
