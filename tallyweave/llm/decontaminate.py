"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items are one automaton over words. A document's words run through it; the
automaton's state always stands for the longest stretch that ends here and occurs in an item. Where
that stretch reaches ``window`` words, the last ``window`` words are a window of an item; items
shorter than a window count when they occur whole. Each document is read once, in one pass without a
shuffle.

The automaton is broadcast. Its size is bounded by ``max_words`` item words: a larger benchmark is
split by a hash of the item into blocks under the bound, and each block's pass adds its hits.

Words are what is left of the text after lower-casing A-Z and splitting at ASCII characters that are
not letters or digits.

Defined cases: null and empty texts have no words and no hits; items without words are no windows;
items with a null id hit words but are not listed; repeated rows are read each on its own; without
benchmark rows nothing is hit; an empty table gives an empty result; other columns are carried
only by ``remove``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, free_name, read_table

_TABLE = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class DecontaminationSpec:
    window: int = 10
    #: Item words in one broadcast automaton (about 400 bytes each).
    max_words: int = 400_000
    #: Removal: hit runs of at least so many words go; documents with a larger hit share go whole.
    min_run: int = 1
    max_coverage: float = 0.8


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences; state 0 is the empty stretch."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: (words, item id) of short items that end at a state; after ``seal`` also those of its suffixes
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        #: items of each window, by its words
        self.items: dict[tuple[bytes, ...], set[str]] = {}

    def add(self, words: list[bytes], item: str | None) -> None:
        if not words:
            return
        last = 0
        for w in words:
            last = self._extend(last, w)
        n = self.window
        if len(words) < n:
            self.short.setdefault(last, []).append((len(words), item))
        for i in range(len(words) - n + 1):
            found = self.items.setdefault(tuple(words[i : i + n]), set())
            if item is not None:
                found.add(item)

    def _state(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the stretches of ``q`` that are no longer than those of ``p`` and one word."""
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the stretch is there from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def seal(self) -> SuffixAutomaton:
        """Let every state list the short items among its suffixes; call after the last ``add``."""
        if self.short:
            for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                if own := [*self.short.get(s, []), *self.short.get(self.link[s], [])]:
                    self.short[s] = own
        return self

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs (start, end) of hit words, merged and in order, and the ids of the items that occur."""
        follow, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        for i, w in enumerate(words):
            to = follow[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = follow[state].get(w)
                matched = length[state]
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= window:
                items |= self.items.get(tuple(words[i + 1 - window : i + 1]), set())
                _put(runs, i + 1 - window, i + 1)
            if short and state in short:
                for n, item in short[state]:
                    if n <= matched:
                        _put(runs, i + 1 - n, i + 1)
                        if item is not None:
                            items.add(item)
        return runs, items


def _put(runs: list[tuple[int, int]], start: int, end: int) -> None:
    """Add a run that ends last; earlier runs that it overlaps or touches are taken into it."""
    while runs and runs[-1][1] >= start:
        s, _ = runs.pop()
        start = min(start, s)
    runs.append((start, end))


def automata(benchmark: DataFrame, spec: DecontaminationSpec = DecontaminationSpec()) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items; the driver holds one block at a time."""
    spaced = F.regexp_replace(F.lower("text"), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", " ")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text", F.size(F.split(spaced, " ")).alias("n"))
    total = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // spec.max_words) * (1 if total <= spec.max_words else 2))
    for block in range(blocks):
        one = SuffixAutomaton(spec.window)
        for row in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).select("item", "text").orderBy("item", "text").collect():
            one.add(words_of(row["text"]), row["item"])
        yield one.seal()


HITS = "array<struct<start:int,end:int>>"


Hit = tuple[list[tuple[int, int]], list[str]]
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(docs: DataFrame, benchmark: DataFrame, spec: DecontaminationSpec, text: str, finish: Callable[[pa.RecordBatch, list[Hit]], pa.RecordBatch], schema) -> DataFrame:
    """One pass for each block of the benchmark; the last one hands each batch of ``docs`` and its hits
    (runs of hit words, ids of items) to ``finish``, so a benchmark of one block takes one Python worker."""
    bounded_batches(docs.sparkSession)
    df = docs.withColumn(free_name("_runs", docs.columns), F.array().cast(HITS)).withColumn(free_name("_items", docs.columns), F.array().cast("array<string>"))
    place, names, between = docs.columns.index(text), df.columns, df.schema
    blocks = automata(benchmark, spec)
    ahead, turn = next(blocks), 0
    while ahead is not None:
        held = docs.sparkSession.sparkContext.broadcast(ahead)
        ahead, turn = next(blocks, None), turn + 1

        def run(batches: Iterator[pa.RecordBatch], held=held, last=ahead is None) -> Iterator[pa.RecordBatch]:
            one = held.value
            for batch in batches:
                hits: list[Hit] = []
                for t, old, ids in zip(batch.column(place).to_pylist(), batch.column(-2).to_pylist(), batch.column(-1).to_pylist(), strict=True):
                    got, found = one.hits(words_of(t))
                    if old:
                        merged: list[tuple[int, int]] = []
                        for s, e in sorted([*got, *((x["start"], x["end"]) for x in old)], key=lambda x: (x[1], x[0])):
                            _put(merged, s, e)
                        got = merged
                    hits.append((got, sorted(found.union(ids))))
                plain = pa.RecordBatch.from_arrays(batch.columns[:-2], names=names[:-2])
                if last:
                    yield finish(plain, hits)
                else:
                    runs = [[{"start": s, "end": e} for s, e in r] for r, _ in hits]
                    yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(runs, _RUNS), pa.array([i for _, i in hits], pa.list_(pa.string()))], names=names)

        df = df.mapInArrow(run, schema if ahead is None else between)
        if turn % 4 == 0 and ahead is not None:  # keeps few Python workers in one task
            df = cut(df)
    return df


def find(docs: DataFrame, benchmark: DataFrame, spec: DecontaminationSpec = DecontaminationSpec(), text: str = "text") -> DataFrame:
    """``docs`` with runs (of hit words, start and end) and items (ids of the items that occur)."""
    names = [*docs.columns, "runs", "items"]

    def finish(batch: pa.RecordBatch, hits: list[Hit]) -> pa.RecordBatch:
        runs = [[{"start": s, "end": e} for s, e in r] for r, _ in hits]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, _RUNS), pa.array([i for _, i in hits], pa.list_(pa.string()))], names=names)

    schema = docs.withColumn("runs", F.array().cast(HITS)).withColumn("items", F.array().cast("array<string>")).schema
    return _scan(docs, benchmark, spec, text, finish, schema)


def report(docs: DataFrame, benchmark: DataFrame, spec: DecontaminationSpec = DecontaminationSpec(), text: str = "text") -> DataFrame:
    """doc_id and the digest of each document's hits."""

    def finish(batch: pa.RecordBatch, hits: list[Hit]) -> pa.RecordBatch:
        n_words = [len(words_of(t)) for t in batch.column(1).to_pylist()]
        n_hit = [sum(e - s for s, e in runs) for runs, _ in hits]
        digest = [hashlib.sha256(",".join(items).encode()).hexdigest() for _, items in hits]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for _, i in hits], pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    done = _scan(rows, benchmark, spec, "text", finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return done.withColumn("contaminated", F.col("n_hit") > 0)


def remove(docs: DataFrame, benchmark: DataFrame, spec: DecontaminationSpec = DecontaminationSpec(), text: str = "text") -> DataFrame:
    """``docs`` without the hit runs of ``min_run`` words or more, and without the documents whose share
    of hit words is above ``max_coverage``; all columns stay."""
    schema, place = docs.schema, docs.columns.index(text)

    def finish(batch: pa.RecordBatch, hits: list[Hit]) -> pa.RecordBatch:
        texts, keep = [], []
        for t, (runs, _) in zip(batch.column(place).to_pylist(), hits, strict=True):
            whole = True
            if runs:
                at = [m.span() for m in _WORD.finditer(t)]
                whole = sum(e - s for s, e in runs) <= spec.max_coverage * len(at)
                parts, last = [], 0
                for s, e in runs:
                    if e - s >= spec.min_run:
                        parts.append(t[last : at[s][0]])
                        last = at[e - 1][1]
                t = "".join([*parts, t[last:]])
            texts.append(t)
            keep.append(whole)
        columns = [pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep, pa.bool_()))

    return _scan(docs, benchmark, spec, text, finish, schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = {
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), win AS (
  SELECT DISTINCT item_id, w[s:s + 9] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS s FROM b WHERE len(w) >= 10)
  UNION SELECT item_id, w FROM b WHERE len(w) BETWEEN 1 AND 9
), grams AS (
  SELECT doc_id, s, n, w[s:s + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT len(g) AS n FROM win))
), hits AS (SELECT doc_id, s, n, item_id FROM grams JOIN win USING (g)), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS i FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(i), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(i, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
