"""Removal of byte strings that occur again anywhere, by a distributed merge sort of suffixes.

A byte goes if a ``length``-byte string that covers it also starts at another place of the corpus.

Every window of ``length`` bytes has one anchor: the leftmost ``gram``-byte string of least hash in it.
Equal windows have equal anchors at equal distances, so only suffixes that begin at anchors (one in
about 185 bytes) need sorting. An anchor row holds hashes of its gram and of its context, the union of
the windows that it anchors. Anchors whose gram occurs once are done; equal contexts are repeated as a
whole and stand for one another; what is left are grams in several contexts. Their contexts are sorted
within each task by the bytes from the anchor on, exchanged as front-coded runs, and merged by loser
trees that keep the common prefix with the last output and never compare it again. The common prefixes
of the merged order and the bytes before the anchors tell which windows are equal.

A gram with more than ``hot`` contexts would make one large group; its windows are counted by 128-bit
hash instead, each as a row of its own, so no task gets the group.

Passages are found by the same sort over codes of words, four bytes each, in place of the text's bytes: a word
counts if a run of 51 words that holds it also occurs in another document, whatever its length in bytes. Nothing
is removed for that; rows of one id and text are one document here. Two different words have one code with a chance of 2^-32, and a false match needs 50 more
words that are equal.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing; repeated rows are
copies of each other; rows with a null id take part; an empty table gives an empty result; other
columns are never read. Matches never cross documents.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, cut, lit_up, read_table, spot
from .near_dups import _BYTES, _powers, mix

_MORE_BYTES = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Window starts handled at a time; positions in a chunk fit in 20 bits.
CHUNK = 1 << 19
_BITS = 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a word's code.
CODE = 4


@dataclass(frozen=True)
class RepeatSpec:
    length: int = 400
    gram: int = 32
    hot: int = 20_000
    #: Contexts that one merging task should get.
    bucket: int = 20_000
    #: Codes of words in place of bytes; ``length`` and ``gram`` are then ``CODE`` times as many as the words.
    words: bool = False
    #: Only what occurs in the text of another key counts.
    across: bool = False

    @property
    def spread(self) -> int:
        return self.length - self.gram + 1

    @property
    def least(self) -> int:
        """Bytes of the shortest text that can have a window."""
        return 2 * (self.length // CODE) - 1 if self.words else self.length

    def data(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        return word_codes(data) if self.words else data


#: Passages of over 50 words.
PASSAGE = RepeatSpec(length=51 * CODE, gram=8 * CODE, words=True, across=True)


def word_codes(data: bytes) -> bytes:
    """The words' codes in order; long texts are split in chunks that end at a space."""
    out, at = [], 0
    while at < len(data):
        space = _SPACE.search(data, at + CHUNK)
        end = space.start() if space else len(data)
        out.append(np.fromiter(map(zlib.crc32, data[at:end].split()), np.dtype("<u4")).tobytes())
        at = end
    return b"".join(out)


class Hashes:
    """Polynomial hashes of all substrings of a byte array, by their ends."""

    def __init__(self, data: np.ndarray, table: np.ndarray) -> None:
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:-1], dtype=np.uint64, out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def anchors(data: bytes, spec: RepeatSpec) -> tuple[np.ndarray, ...]:
    """pos, lo, hi, gram hash and context hash: the windows that start lo..hi bytes before pos have
    their anchor there."""
    n, w = len(data), spec.spread
    rows: list[tuple[np.ndarray, ...]] = []
    for at in range(0, n - spec.length + 1, CHUNK):
        part = np.frombuffer(data, np.uint8, min(n - at, CHUNK + spec.length - 1), at)
        h = Hashes(part, _BYTES)
        m = len(part) - spec.gram + 1
        grams = mix((h.total[spec.gram :] - h.total[:m]) * h.down[:m])
        order = (grams >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(m, dtype=np.uint64)
        blocks = -(-m // w)
        padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:m] = order
        grid = padded.reshape(blocks, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = m - w + 1
        least = np.minimum(after[:count], before[w - 1 : w - 1 + count])
        pos = (least & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
        last = np.concatenate((first[1:] - 1, [count - 1]))
        rows.append((pos[first] + at, first + at, last + at, grams[pos[first]]))
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    pos, first, last, grams = (np.concatenate(x) for x in zip(*rows, strict=True))
    new = np.concatenate(([True], pos[1:] != pos[:-1]))  # an anchor's windows may lie in two chunks
    start = np.flatnonzero(new)
    pos, first, last, grams = pos[start], first[start], last[np.concatenate((start[1:], [len(new)])) - 1], grams[start]
    contexts = np.empty(len(pos), np.uint64)
    step = 1 << 12
    for at in range(0, len(pos), step):  # contexts of neighbouring anchors share a stretch of bytes
        a, b = int(first[at]), int(last[min(at + step, len(pos)) - 1]) + spec.length
        h = Hashes(np.frombuffer(data, np.uint8, b - a, a), _MORE_BYTES)
        s = slice(at, at + step)
        contexts[s] = h.of(first[s] - a, last[s] + spec.length - a)
    lo, hi = pos - last, pos - first
    contexts = mix(contexts + (lo * 1009 + hi).astype(np.uint64))
    return pos, lo, hi, grams.view(np.int64), contexts.view(np.int64)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 16
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while a[at] == b[at]:
        at += 1
    return at


def front_code(sorted_strings: list[bytes]) -> list[tuple[int, bytes]]:
    out, last = [], b""
    for s in sorted_strings:
        k = common(last, s, 0)
        out.append((k, s[k:]))
        last = s
    return out


def merge(runs: list[list[tuple[int, bytes]]]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, index in it, common prefix with the output before, string) in sorted order.

    A loser tree over front-coded sorted runs. Each contender keeps its common prefix with the last
    output; of two that differ in it the longer one is smaller, and only equal ones compare bytes,
    from there on.
    """
    size = 1
    while size < max(len(runs), 1):
        size *= 2
    head: list[bytes | None] = [None] * size
    place, known = [-1] * size, [0] * size

    def advance(r: int) -> None:
        place[r] += 1
        if r < len(runs) and place[r] < len(runs[r]):
            k, tail = runs[r][place[r]]
            head[r] = (head[r] or b"")[:k] + tail
            known[r] = k
        else:
            head[r] = None

    def beats(x: int, y: int) -> bool:
        """Whether run x's head goes before run y's; the loser's known prefix becomes that with the winner."""
        a, b = head[x], head[y]
        if a is None or b is None:
            return b is None and (a is not None or x < y)
        if known[x] != known[y]:
            return known[x] > known[y]
        k = common(a, b, known[x])
        first = k == len(a) and (len(b) > k or x < y) or k < len(a) and k < len(b) and a[k] < b[k]
        known[y if first else x] = k
        return first

    for r in range(size):
        advance(r)
    tree = [0] * size  # losers; tree[0] is the winner
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        x, y = winners[2 * node], winners[2 * node + 1]
        win = beats(x, y)
        winners[node], tree[node] = (x, y) if win else (y, x)
    top = winners[1] if size > 1 else 0
    while head[top] is not None:
        yield top, place[top], known[top], head[top]
        advance(top)
        node = (top + size) // 2
        while node:
            if beats(tree[node], top):
                tree[node], top = top, tree[node]
            node //= 2


def equal_windows(lcp: list[int], rights: list[bytes], lefts: list[bytes], lo: list[int], hi: list[int], spec: RepeatSpec, owners: list[tuple[int, int]] | None = None) -> list[list[tuple[int, int]]]:
    """For each context of one gram, in sorted order, the runs (l1, l2) of its windows that another has too.

    ``lcp[i]``: common prefix of the right sides i - 1 and i. ``owners``: least and greatest document of each
    context; with them, windows that one document alone has do not count.
    """
    n, length = len(rights), spec.length
    if n <= 8:
        out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for i in range(n):
            near = length
            for j in range(i + 1, n):
                near = min(near, lcp[j])
                if owners and owners[i] == owners[j] and owners[i][0] == owners[i][1]:
                    continue
                back = common(lefts[i][::-1], lefts[j][::-1], 0)
                if near + back >= length:
                    for x in (i, j):
                        a, b = max(lo[x], length - near), min(hi[x], back)
                        if a <= b:
                            out[x].append((a, b))
        return out
    width = max(hi)
    grid = np.zeros((n, width + 1), np.uint64)  # hash of the l bytes before the anchor
    for i, s in enumerate(lefts):
        back = np.frombuffer(s[::-1], np.uint8)
        grid[i, 1 : len(back) + 1] = mix(np.cumsum(_BYTES[back] * _powers(len(back) + 1)[0][:-1], dtype=np.uint64))
    low, high, gaps = np.array(lo), np.array(hi), np.array(lcp)
    least, most = np.array(owners, np.int64).T if owners else (None, None)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for at in range(min(lo), width + 1):
        rows = np.flatnonzero((low <= at) & (at <= high))
        if len(rows) < 2:
            continue
        apart = np.cumsum(gaps < length - at)
        key = mix(grid[rows, at] + apart[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, where, many = np.unique(key, return_inverse=True, return_counts=True)
        again = many > 1
        if owners and again.any():
            a, b = np.full(len(many), np.iinfo(np.int64).max), np.full(len(many), np.iinfo(np.int64).min)
            np.minimum.at(a, where, least[rows])
            np.maximum.at(b, where, most[rows])
            again &= a < b
        for i in rows[again[where]].tolist():
            if found[i] and found[i][-1][1] == at - 1:
                found[i][-1] = (found[i][-1][0], at)
            else:
                found[i].append((at, at))
    return found


def _runs_of(batch: pa.RecordBatch, buckets: int) -> pa.RecordBatch:
    """Front-coded sorted runs of a batch of texts with their wanted contexts, one for each bucket."""
    by: dict[int, list[tuple[bytes, bytes, int, int, int, int, tuple[int | None, int | None]]]] = {}
    for z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        data = zstandard.ZstdDecompressor().decompress(z)
        for x in wanted:
            p = x["pos"]
            by.setdefault(x["h"] % buckets, []).append((data[p : p + x["right"]], data[p - x["hi"] : p], x["lo"], x["hi"], x["h"], x["c"], (x.get("least"), x.get("most"))))
    keys, blobs = [], []
    for bucket, items in by.items():
        items.sort()
        keys.append(bucket)
        blobs.append(pickle.dumps((front_code([x[0] for x in items]), [x[1:] for x in items]), protocol=5))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "run"])


def merged_windows(texts: DataFrame, total: int, spec: RepeatSpec) -> DataFrame:
    """h, c, l1 and l2 of windows that two contexts of a gram share. ``texts``: z (compressed) and wanted."""
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // spec.bucket))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                yield _runs_of(batch.slice(at, 2000), buckets)

    def combine(table: pa.Table) -> pa.Table:
        loaded = [pickle.loads(x) for x in table["run"].to_pylist()]
        out: list[tuple[int, int, int, int]] = []
        group: list[tuple] = []

        def close() -> None:
            if len(group) > 1:
                lcp, rights, metas = [g[0] for g in group], [g[1] for g in group], [g[2] for g in group]
                got = equal_windows(lcp, rights, [m[0] for m in metas], [m[1] for m in metas], [m[2] for m in metas], spec, [m[5] for m in metas] if spec.across else None)
                for meta, spans in zip(metas, got, strict=True):
                    out.extend((meta[3], meta[4], a, b) for a, b in sorted(set(spans)))
            group.clear()

        for r, i, k, s in merge([x[0] for x in loaded]):
            if k < spec.gram:
                close()
            group.append((k, s, loaded[r][1][i]))
        close()
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "c", "l1", "l2"])

    sent = texts.select("z", "wanted").mapInArrow(runs, "bucket long, run binary")
    return sent.groupBy("bucket").applyInArrow(combine, "h long, c long, l1 int, l2 int")


def counted_windows(texts: DataFrame, spec: RepeatSpec) -> DataFrame:
    """The same for contexts of grams that are too frequent for one group, by hashes of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = zstandard.ZstdDecompressor().decompress(z)
                for x in wanted:
                    a, b = x["pos"] - x["hi"], x["pos"] - x["lo"] + spec.length
                    part = np.frombuffer(data, np.uint8, b - a, a)
                    start = np.arange(x["hi"] - x["lo"] + 1)
                    one, two = (Hashes(part, t).of(start, start + spec.length).view(np.int64) for t in (_BYTES, _MORE_BYTES))
                    k = len(start)
                    owners = [pa.array([x.get(name)] * k, pa.int64()) for name in ("least", "most")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, x["h"])), pa.array(np.full(k, x["c"])), pa.array((x["hi"] - start).astype(np.int32)), pa.array(one), pa.array(two), *owners], names=["h", "c", "l1", "w1", "w2", "least", "most"])

    rows = cut(texts.select("z", "wanted").mapInArrow(run, "h long, c long, l1 int, w1 long, w2 long, least long, most long"))
    repeated = F.min("least") < F.max("most") if spec.across else F.count("*") > 1
    again = rows.groupBy("w1", "w2").agg(repeated.alias("again")).where("again").select("w1", "w2")
    return rows.join(again, ["w1", "w2"]).select("h", "c", "l1", F.col("l1").alias("l2"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of two columns: the id and a hash of the row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "doc_id", "text")


def _pressed(keyed: DataFrame, table: np.ndarray, spec: RepeatSpec) -> DataFrame:
    """doc_id, k1, k2 and z, the compressed bytes or codes, of the rows whose key is in the bitmap."""
    held = keyed.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            take = batch.filter(pa.array(lit_up(held.value, batch.column(4).to_numpy())))
            z = pa.array([press.compress(spec.data(t)) for t in take.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*take.columns[:3], z], names=["doc_id", "k1", "k2", "z"])

    return keyed.select("doc_id", "k1", "k2", "text", spot("k1", "k2").alias("at")).mapInArrow(run, "doc_id long, k1 long, k2 long, z binary")


def repeated_spans(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """k1, k2 (key of a row) and spans, the byte ranges (s, e) of its repeated windows, not yet merged."""
    keyed = _keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                got = anchors(spec.data(text), spec)
                found.append((np.full(len(got[0]), i), *got))
            row, pos, lo, hi, h, c = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 6
            take = pa.array(row.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(h), pa.array(c)], names=["k1", "k2", "pos", "lo", "hi", "h", "c"])

    long_enough = keyed.where(F.octet_length("text") >= spec.least).select("k1", "k2", "text")
    rows = cut(long_enough.mapInArrow(run, "k1 long, k2 long, pos int, lo int, hi int, h long, c long"))
    owner = F.xxhash64("k1", "k2")
    owners = {"least": F.min(owner).alias("least"), "most": F.max(owner).alias("most")} if spec.across else {}
    contexts = rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos", "lo", "hi")).alias("at"), *owners.values())
    grams = contexts.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where("all > 1")
    known = cut(contexts.join(grams, "h").select("h", "c", "n", "at", "kinds", *owners))

    def wanted(which: Column) -> DataFrame:
        one = F.struct("at.pos", "at.lo", "at.hi", "h", "c", (F.lit(spec.length) - F.col("at.lo")).alias("right"), *owners)
        asked = cut(known.where(which).groupBy("at.k1", "at.k2").agg(F.collect_list(one).alias("wanted")))
        # rows that repeat have one key; any of them will do
        return _pressed(keyed, bitmap(asked, "k1", "k2"), spec).join(asked, ["k1", "k2"])

    several = known.where("kinds > 1").agg(F.count("*"), F.coalesce(F.max("kinds"), F.lit(0))).first()
    whole = known.where("least < most" if spec.across else "n > 1").select("h", "c", F.col("at.lo").alias("l1"), F.col("at.hi").alias("l2"))
    parts = [whole]
    if several[0]:
        parts.append(merged_windows(wanted((F.col("kinds") > 1) & (F.col("kinds") <= spec.hot)), several[0], spec))
    if several[1] > spec.hot:
        parts.append(counted_windows(wanted(F.col("kinds") > spec.hot), spec))
    shared = parts[0]
    for x in parts[1:]:
        shared = shared.unionByName(x)
    spans = F.collect_list(F.struct("l1", "l2")).alias("ls")
    shared = cut(shared.groupBy("h", "c").agg(spans))
    start, end = F.col("pos") - F.col("l.l2"), F.col("pos") - F.col("l.l1") + spec.length
    hit = rows.select("k1", "k2", "pos", "h", "c").join(shared, ["h", "c"]).select("k1", "k2", "pos", F.explode("ls").alias("l"))
    return hit.select("k1", "k2", F.struct(start.alias("s"), end.alias("e")).alias("x")).groupBy("k1", "k2").agg(F.collect_set("x").alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SCHEMA = "k1 long, k2 long, doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def _out(keys: list[pa.Array], out: list[tuple[bytes, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([*keys, pa.array(columns[0], pa.binary()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["k1", "k2", "doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def _removed(docs: DataFrame, spec: RepeatSpec) -> DataFrame:
    """The columns of ``remove_repeats`` and the key of the row."""
    keyed = _keyed(docs)
    spans = cut(repeated_spans(docs, spec))
    table = bitmap(spans, "k1", "k2")
    held = docs.sparkSession.sparkContext.broadcast(table)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~lit_up(held.value, batch.column(4).to_numpy())))
            data = [t.encode("utf-8", "surrogatepass") for t in rest.column(3).to_pylist()]
            yield _out(rest.columns[:3], [(d, len(d), 0, 0) for d in data])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for z, found in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                data, runs = zstandard.ZstdDecompressor().decompress(z), merged(found)
                parts, at = [], 0
                for s, e in runs:
                    parts.append(data[at:s])
                    at = e
                out.append((b"".join([*parts, data[at:]]), len(data), sum(e - s for s, e in runs), len(runs)))
            yield _out(batch.columns[:3], out)

    rest = keyed.select("k1", "k2", "doc_id", "text", spot("k1", "k2").alias("at")).mapInArrow(untouched, SCHEMA)
    touched = _pressed(keyed, table, spec).join(spans, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "z", "spans").mapInArrow(run, SCHEMA)
    return rest.union(touched)


def remove_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed and n_spans, one row per input row.

    Only texts with repeated windows meet their spans in a join; the others pass as they are.
    """
    return _removed(docs, spec).drop("k1", "k2")


def repeated_passages(docs: DataFrame, spec: RepeatSpec = PASSAGE) -> DataFrame:
    """k1, k2 (key of a row), n_passages (maximal runs of words in repeated windows) and n_passage_words, of
    the rows that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a window may begin or end inside a code: the whole words in it count
            runs = [merged([{"s": -(-x["s"] // CODE), "e": x["e"] // CODE} for x in found]) for found in batch.column(2).to_pylist()]
            counts = [pa.array([len(r) for r in runs], pa.int64()), pa.array([sum(e - s for s, e in r) for r in runs], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *counts], names=["k1", "k2", "n_passages", "n_passage_words"])

    return repeated_spans(docs, spec).mapInArrow(run, "k1 long, k2 long, n_passages long, n_passage_words long")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    passages = cut(repeated_passages(docs))
    done = _removed(docs, RepeatSpec()).select("k1", "k2", "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_passages", "n_passage_words")]
    return done.join(passages, ["k1", "k2"], "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *counts)


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
