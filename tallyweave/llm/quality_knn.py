"""Quality classifier: similarity-weighted voting of the nearest labelled documents.

A text is its TF-IDF vector over hashed words and pairs of words that follow one another, and over pairs
of neighbouring byte classes (letters, capitals, digits, punctuation, ...), counted over the whole text,
block by block. A truncated SVD of at most ``fit_rows`` labelled vectors gives the latent semantic space;
the labelled vectors in it are broadcast (``fit_rows`` x ``dims`` floats), and every document gets its
exact cosine products with all of them, block by block. The ``k`` nearest vote with their similarity as
weight.

The inverse document frequencies are counted over all documents; the labelled rows are drawn by a
hash of the id, by label, and reweighted so that each label keeps its share of the votes.

Defined cases: null and empty texts have no terms and get the share of good labels as score; without
any label every score is that prior of one half; repeated rows are scored each on its own; an empty
table gives an empty result; other columns are carried only by ``attach``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, read_table
from .near_dups import _BYTES, _powers, mix

CLASSES = 64
PAIRS = CLASSES * CLASSES
#: Buckets of hashed words and word pairs, after those of the byte classes.
TERMS = 1 << 12
SIZE = PAIRS + TERMS
#: Bytes of a text that are counted at a time.
BLOCK = 1 << 18


def _byte_classes() -> np.ndarray:
    """Class of each byte: letters one by one, capitals in two classes, digits in one, signs on their own."""
    table = np.full(256, 63, np.int64)
    for i in range(26):
        table[ord("a") + i] = i
        table[ord("A") + i] = 26 + (i % 2)
    for i, signs in enumerate([b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"#", b"*", b"$", b"%", b"&", b"<", b">", b"-_", b":;", b"\"'", b"()", b"[]{}", b"=+", b"/\\", b"@", b"~^`"], 28):
        table[list(signs)] = i
    for b in range(128, 256):
        table[b] = 53 + (b % 10)
    return table


BYTE_CLASS = _byte_classes()
#: Letters A to Z as small ones, white space as the blank.
LOWER = np.array([c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256)], np.uint8)
TERM_SHIFT = np.uint64(64 - 12)
#: The pair of two stray control bytes also counts the characters of words that repeat the word before.
REPEATED = PAIRS - 1


@dataclass(frozen=True)
class QualitySpec:
    fit_rows: int = 3000
    #: Share of the squared length of a vector that words and word pairs have.
    words: float = 0.25
    dims: int = 24
    k: int = 5
    block: int = 512


@dataclass
class QualityModel:
    idf: np.ndarray  # with the weight of each kind of term in it
    basis: np.ndarray  # [term, dim]
    vectors: np.ndarray  # labelled unit vectors [row, dim]
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    k: int

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Scores of a block of count vectors."""
        out = np.full(len(counts), self.prior)
        if not len(self.vectors):
            return out
        x = unit(tf_idf(counts, self.idf) @ self.basis)
        used = np.abs(x).sum(1) > 0
        if used.any():
            sims = x[used] @ self.vectors.T
            k = min(self.k, sims.shape[1])
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            s = np.maximum(np.take_along_axis(sims, near, 1), 1e-6) * self.weights[near]
            out[used] = (s * self.labels[near]).sum(1) / s.sum(1)
        return np.clip(out, 0.0, 1.0)


def _blocks(data: bytes) -> Iterator[bytes]:
    """Stretches of about ``BLOCK`` bytes that end between words, or anywhere in a longer word."""
    at = 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):
            end = max(data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end)) + 1 or end
        yield data[at:end]
        at = end


def term_counts(text: str | None) -> np.ndarray:
    """Counts of the text's byte-class pairs, doubled words, words and word pairs."""
    counts = np.zeros(SIZE, np.int64)
    before, last = -1, np.zeros(0, np.uint64)
    for part in _blocks(text.encode("utf-8", "surrogatepass") if text else b""):
        data = np.frombuffer(part, np.uint8)
        c = BYTE_CLASS[data]
        counts[:PAIRS] += np.bincount(c[:-1] * CLASSES + c[1:], minlength=PAIRS)
        if before >= 0:
            counts[before * CLASSES + c[0]] += 1
        before = int(c[-1])
        low = LOWER[data]
        inside = np.concatenate(([False], low != 32, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        if not len(start):
            continue
        up, down = _powers(len(low) + 1)
        total = np.zeros(len(low) + 1, np.uint64)
        np.cumsum(_BYTES[low] * up[:-1], dtype=np.uint64, out=total[1:])
        h = mix((total[end] - total[start]) * down[start])
        counts[PAIRS:] += np.bincount((h >> TERM_SHIFT).astype(np.int64), minlength=TERMS)
        h, width = np.concatenate((last, h)), np.concatenate((np.zeros(len(last), np.int64), end - start))
        counts[PAIRS:] += np.bincount((mix(h[:-1] * np.uint64(3) + h[1:]) >> TERM_SHIFT).astype(np.int64), minlength=TERMS)
        counts[REPEATED] += int((width[1:] + 1)[h[1:] == h[:-1]].sum())
        last = h[-1:]
    return counts.astype(np.int32)


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.empty(counts.shape, np.float32)
    for part in (slice(0, PAIRS), slice(PAIRS, SIZE)):
        total = np.maximum(counts[:, part].sum(1, keepdims=True), 1).astype(np.float32)
        out[:, part] = np.sqrt(counts[:, part] / total, dtype=np.float32) * idf[part]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def principal(x: np.ndarray, dims: int, rounds: int = 8) -> np.ndarray:
    """The leading right singular vectors of ``x``, by subspace iteration in a few columns more."""
    q = np.random.default_rng(1).standard_normal((x.shape[1], min(dims + 16, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, turn = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray((q @ turn.T)[:, :dims]).astype(np.float32)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of all texts hold each term; at most a row for each term from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df += term_counts(text) > 0
                rows += 1
        idx = df.nonzero()[0]
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.append(idx, -1), pa.int64()), "n": pa.array(np.append(df[idx], rows), pa.int64())})

    table = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pair, n = table["pair"].to_numpy(), table["n"].to_numpy()
    df = np.zeros(SIZE)
    df[pair[pair >= 0]] = n[pair >= 0]
    return df, int(n[pair < 0].sum())


def train(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec(), label: str = "quality") -> QualityModel:
    """``docs``: doc_id and text of all documents; ``labels``: doc_id and label of the rows to learn from."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    df, n = document_frequencies(docs.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    idf[:PAIRS] *= np.sqrt(1 - spec.words)
    idf[PAIRS:] *= np.sqrt(spec.words)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    size, half = 1 << 30, spec.fit_rows // 2
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    empty = QualityModel(idf, np.zeros((SIZE, 0), np.float32), np.zeros((0, 0), np.float32), np.zeros(0), np.zeros(0), 0.5, spec.k)
    if not counts:
        return empty
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(size))
    keep = F.lit(False)
    for y, c in counts.items():
        keep = keep | ((F.col("y") == y) & (h < int(min(1.0, 1.2 * half / c) * size)))
    picked = known.select("doc_id", "y", h.alias("h")).where(keep)  # about 1.2 x fit_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [term_counts(t) for t in batch.column(2).to_pylist()]
            idx = [r.nonzero()[0].astype(np.int16) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(idx, pa.list_(pa.int16())), pa.array([r[i] for r, i in zip(rows, idx, strict=True)], pa.list_(pa.int32()))], names=["h", "y", "i", "c"])

    rows = docs.join(F.broadcast(picked), "doc_id").select("h", "y", "text").mapInArrow(run, "h long, y int, i array<short>, c array<int>").toArrow()
    if not rows.num_rows:
        return empty
    order = np.argsort(rows["h"].to_numpy(), kind="stable")
    y = rows["y"].to_numpy()[order]
    order = np.concatenate([order[y == v][:half] for v in (0, 1)])
    y = rows["y"].to_numpy()[order].astype(float)
    idx, values = rows["i"].combine_chunks(), rows["c"].combine_chunks()
    x = np.zeros((len(order), SIZE), np.float32)
    for at, i in enumerate(order.tolist()):
        row = np.zeros((1, SIZE), np.int32)
        row[0, idx[i].values.to_numpy()] = values[i].values.to_numpy()
        x[at] = unit(tf_idf(row, idf))[0]
    full = np.abs(x).sum(1) > 0
    x, y = x[full], y[full]
    total = sum(counts.values())
    weights = np.array([counts.get(int(v), 0) / total / max(1, (y == v).sum()) for v in y])
    prior = counts.get(1, 0) / total
    if not len(y):
        return QualityModel(idf, empty.basis, empty.vectors, y, y, prior, spec.k)
    basis = principal(x, min(spec.dims, len(y)))
    return QualityModel(idf, basis, unit(x @ basis), y, weights * len(y), prior, spec.k)


def attach(docs: DataFrame, model: QualityModel, spec: QualitySpec = QualitySpec(), text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of each row's whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    place, schema = docs.columns.index(text), docs.select("*", F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts, scores = batch.column(place), []
            for at in range(0, len(texts), spec.block):
                scores.append(m.score(np.array([term_counts(t) for t in texts.slice(at, spec.block).to_pylist()])))
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, score])

    return docs.mapInArrow(run, schema)


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    done = attach(docs, model).drop("text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return done.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"))


QUERIES = {"op3_quality_knn": op3_quality_knn}
ORACLE_SQL: dict[str, str] = {}
