"""Packing into fixed-length training sequences: vector bin packing by the dot-product heuristic.

An example takes tokens, one segment and loss-bearing tokens; a sequence has a limit on each. The
loss-bearing tokens come from a column of the caller (instruction data: those of the answers); without
one they are all but the first, which nothing predicts. Into
the open sequence goes, among the examples that fit, the one whose demand has the largest dot product
with what is left, both as shares of the limits. When nothing fits, an example is cut at the free
space (if ``splittable``), so sequences fill exactly. Whole sequences are cut off long examples first.

Each task packs what it reads: a window of ``window`` examples at a time, nothing is shuffled, and a
task that is run again makes the same pieces. What a task has left at its end goes into sequences of
lengths that are powers of two, which need no padding and keep the same three limits.

Token ids are those of the ``tokenizers`` library for the vocabulary file; texts of plain Latin
script without special-token strings are encoded by the equivalent rank file with tiktoken, which
gives the same ids faster. Both paths are parameters.

Defined cases: null and empty texts are the end id alone; repeated rows are packed each on its own;
an empty table gives an empty result; other columns are never read; a text of any length is cut.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read_table


@dataclass(frozen=True)
class PackSpec:
    max_tokens: int = 2048
    max_segments: int = 64
    max_loss: int = 2048
    window: int = 1024
    splittable: bool = True


@dataclass
class Item:
    """``key`` is the caller's; tokens start..start+length of it, of which ``loss`` bear loss."""

    key: object
    start: int
    length: int
    loss: int


@dataclass
class Packer:
    """Yields (key, start, length, sequence, offset); sequences count up from ``first``."""

    spec: PackSpec
    first: int = 0
    waiting: list[Item] = field(default_factory=list)

    def add(self, key: object, length: int, loss: int | None = None) -> Iterator[tuple[object, int, int, int, int]]:
        """``loss``: loss-bearing tokens, taken as spread evenly; all of them by default."""
        spec, start, loss = self.spec, 0, length if loss is None else loss
        if length > spec.max_tokens and not spec.splittable:
            raise ValueError(f"an example of {length} tokens does not fit and may not be cut")
        while length - start >= spec.max_tokens and loss * spec.max_tokens <= spec.max_loss * length:
            yield key, start, spec.max_tokens, self.first, 0
            self.first += 1
            start += spec.max_tokens
        if start < length:
            self.waiting.append(Item(key, start, length - start, -(-loss * (length - start) // length)))
        if len(self.waiting) >= self.spec.window:
            yield from self._pack(self.spec.window // 2)

    def finish(self) -> Iterator[tuple[object, int, int, int, int]]:
        yield from self._pack(0)

    def _pack(self, keep: int) -> Iterator[tuple[object, int, int, int, int]]:
        """Close sequences until ``keep`` examples wait; at the end, the open one too."""
        spec, items = self.spec, self.waiting
        limit = np.array([spec.max_tokens, spec.max_segments, spec.max_loss], float)
        need = np.array([[x.length, 1, x.loss] for x in items], float).reshape(-1, 3)
        here = np.ones(len(items), bool)
        while here.sum() > keep:
            left, bin_ = limit.copy(), []
            while True:
                fits = here & (need <= left).all(1)
                if not fits.any():
                    break
                gain = need / limit @ (left / limit)
                i = int(np.where(fits, gain, -1.0).argmax())
                bin_.append(items[i])
                here[i] = False
                left -= need[i]
                if not left[0]:
                    break
            if spec.splittable and left[0] >= 1 and left[1] >= 1 and left[2] >= 1 and here.any():
                gain = need / limit @ (left / limit)
                i = int(np.where(here, gain, -1.0).argmax())
                x = items[i]
                n = int(min(left[0], left[2] * x.length // max(x.loss, 1)))
                if 0 < n < x.length:
                    part = -(-x.loss * n // x.length)
                    bin_.append(Item(x.key, x.start, n, part))
                    x = items[i] = Item(x.key, x.start + n, x.length - n, x.loss - part)
                    need[i] = x.length, 1, x.loss
            total = sum(x.length for x in bin_)
            if not here.any() and spec.splittable:
                yield from self._powers(bin_, total)
            else:
                yield from self._close(bin_)
        self.waiting = [x for x, h in zip(items, here, strict=True) if h]

    def _close(self, items: list[Item]) -> Iterator[tuple[object, int, int, int, int]]:
        at = 0
        for x in items:
            yield x.key, x.start, x.length, self.first, at
            at += x.length
        self.first += 1

    def _powers(self, items: list[Item], total: int) -> Iterator[tuple[object, int, int, int, int]]:
        """The last examples, cut into sequences whose lengths are powers of two: each time the largest
        that the tokens left fill without passing the limits on segments and loss."""
        queue = list(reversed(items))
        while total:
            room = 1 << (total.bit_length() - 1)
            while True:
                part, rest = _taken(queue, room)
                if room == 1 or len(part) <= self.spec.max_segments and sum(x.loss for x in part) <= self.spec.max_loss:
                    break
                room //= 2
            queue, total = rest, total - room
            yield from self._close(part)


def _taken(queue: list[Item], room: int) -> tuple[list[Item], list[Item]]:
    """The first ``room`` tokens of a queue (its first example is last), and what is left of it."""
    part, rest = [], list(queue)
    while room:
        x = rest.pop()
        n = min(room, x.length)
        loss = -(-x.loss * n // x.length)
        part.append(Item(x.key, x.start, n, loss))
        if n < x.length:
            rest.append(Item(x.key, x.start + n, x.length - n, x.loss - loss))
        room -= n
    return part, rest


#: Characters outside printable ASCII, tab, line ends and Latin letters: such texts take the slow path.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")
_ENCODERS: dict[tuple[str, str | None], Callable[[str], list[int]]] = {}


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids; built once in a process."""
    if (vocabulary, ranks) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(vocabulary)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]

        def exact(text: str) -> list[int]:
            return whole.encode(text, add_special_tokens=False).ids

        found: Callable[[str], list[int]] = exact
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

            def found(text: str) -> list[int]:
                return exact(text) if _OTHER.search(text) or any(s in text for s in special) else fast(text)

        _ENCODERS[vocabulary, ranks] = found
    return _ENCODERS[vocabulary, ranks]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 1, spec: PackSpec = PackSpec(), text: str = "text", loss: str | None = None) -> DataFrame:
    """One row per piece of each document's ids: where it lies in the document and in its sequence.

    ``loss``: column with the number of loss-bearing ids of each example; null counts as none, and more
    than the example has as all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks, pattern)
        packer = Packer(spec, TaskContext.get().partitionId() << 33)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def rows(pieces: list) -> pa.RecordBatch:
            out = [(k[0], s, n, crc32(k[1][s : s + n].tobytes()), len(k[1]), q, o) for k, s, n, q, o in pieces]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            done = []
            for doc_id, t, bearing in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.array([*encode(t or ""), end_id], "<u4")
                done += packer.add((doc_id, ids), len(ids), len(ids) - 1 if loss is None else min(max(bearing or 0, 0), len(ids)))
                if len(done) >= 20_000:
                    yield rows(done)
                    done = []
            if done:
                yield rows(done)
        if done := list(packer.finish()):
            yield rows(done)

    bounded_batches(docs.sparkSession)
    bearing = F.lit(None) if loss is None else F.col(loss)
    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), bearing.cast("long").alias("loss")).mapInArrow(run, SCHEMA)


def default_files() -> tuple[str, str, str]:
    """Vocabulary, ranks and split pattern of the installed byte-level tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), *default_files())


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
