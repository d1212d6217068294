"""MinHash near-duplicates by a signature-coordinate inverted join.

A document is the set of its five-word shingles. Documents with equal sets are one class. Every class
has ``coordinates`` MinHash values and is posted under its (coordinate, value) pairs. Two classes with
at least ``matches`` equal coordinates share one of the ``coordinates - matches + 1`` that come first
in any order common to all; the order is from rare to frequent values by their exact counts, so values
that nobody shares fill the prefix unposted and values of widely shared passages are skipped. Candidate
pairs of a posting list count their collisions on the whole signatures, pairs with ``matches`` or more
go on, and links are confirmed on the full shingle sets.

A posting list never emits all its pairs. First each member meets the list's most central member (the
one whose values are the most frequent); groups of near copies become one component by that. Then only
pairs across components are left: those of lists of at most ``short`` members one by one, while members
of longer lists are posted under the rarest quarter of their full shingle sets, of which two sets that
are similar enough share one. There the exact place of a shared shingle in both sets bounds what the
two can have in common, shingles with the same members count as one, and only pairs that can still be
similar enough are made.
Components are found by hooking roots to their smallest neighbours with pointer jumping, on the cluster.

Defined cases: null, empty and blank texts have no shingles and are alone; texts of fewer than five
words are one shingle; rows that repeat are copies of one class and stay rows of the result; rows
with a null id take part with the smallest id of the others (null if alone); an empty table gives an
empty result; other columns are carried only by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap, bitmap_of, cut, lit_up, read_table, spot

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Words hashed at a time; bounds the memory that one text takes.
CHUNK = 1 << 17


@dataclass(frozen=True)
class NearDupSpec:
    width: int = 5
    #: Links have 100 * intersection >= percent * union.
    percent: int = 75
    coordinates: int = 64
    matches: int = 34
    #: Members of a posting list whose pairs across components are met one by one.
    short: int = 16

    @property
    def prefix(self) -> int:
        return self.coordinates - self.matches + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit values: every bit of the result depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            with np.errstate(over="ignore"):
                _POWERS[name] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1 << 16) - 1, base, np.uint64), dtype=np.uint64)))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    found = []
    for at in range(0, len(words) - width + 1, CHUNK):
        part = words[at : at + CHUNK + width - 1]
        joined = np.frombuffer(b" ".join(part), np.uint8)
        up, down = _powers(len(joined) + 1)
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum(_BYTES[joined] * up[:-1], dtype=np.uint64, out=total[1:])
        size = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size + 1) - 1
        start = end - size
        n = len(part) - width + 1
        found.append(mix((total[end[width - 1 :]] - total[start[:n]]) * down[start[:n]]))
    return np.unique(np.concatenate(found))


def _factors(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(items: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` MinHash values (32 bits) of a set that is not empty."""
    a, b = _factors(k)
    best = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(items), 2048):
        part = items[at : at + 2048]
        best = np.minimum(best, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).astype(np.uint32).min(1))
    return best


def signed(docs: DataFrame, spec: NearDupSpec) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set; null without shingles) and sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text, spec.width)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s, spec.coordinates).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _places(sig: np.ndarray) -> np.ndarray:
    """64-bit key of each (coordinate, value) of rows of signatures."""
    return mix((np.arange(sig.shape[1], dtype=np.uint64) << np.uint64(32)) + sig.astype(np.uint64) + np.uint64(1))


def _rows(column: pa.Array, k: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, k)


def counted(items: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """place and n of the hashes that occur twice or more in ``items``; each batch sends a hash once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                place, n = np.unique(hashes(batch), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(n)], names=["place", "n"])

    return cut(items.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where("n > 1"))


def low_bits(places: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the low bits of ``place``, which keeps most hashes that occur once out
    of the shuffles that follow; what it lets through is dropped by the joins."""
    return bitmap_of(places, (F.col("place").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1))


def seen(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return lit_up(table, (places & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64) + 1)


def postings(classes: DataFrame, spec: NearDupSpec) -> DataFrame:
    """place, rep and mass: the prefix coordinates of every class, and how central the class is.

    Values that occur once come first in the common order; nobody can meet there, so they are not posted.
    """
    k = spec.coordinates
    shared = counted(classes.select("sig"), lambda batch: _places(_rows(batch.column(0), k)).ravel())
    held = classes.sparkSession.sparkContext.broadcast(low_bits(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = _places(_rows(batch.column(1), k)).ravel()
                take = seen(held.value, places)
                yield pa.RecordBatch.from_arrays([pa.array(places[take].view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), k)[take])], names=["place", "rep"])

    rows = classes.select("rep", "sig").mapInArrow(run, "place long, rep long").join(shared.hint("merge"), "place")
    ordered = rows.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "place"))).alias("s"), F.sum((F.log1p("n") * 1000).cast("long")).alias("mass"))
    first = F.slice("s", F.lit(1), F.greatest(F.lit(0), F.size("s") - F.lit(k - spec.prefix)))
    return ordered.select("rep", "mass", F.explode(first).alias("e")).select("e.place", "rep", "mass")


def colliding(pairs: DataFrame, classes: DataFrame, spec: NearDupSpec) -> DataFrame:
    """The pairs (a, b) whose signatures have at least ``matches`` equal coordinates.

    Only the low byte of each value is sent, which can add pairs but never loses one.
    """
    k, least = spec.coordinates, spec.matches
    low = classes.select("rep", "low")
    both = pairs.join(low.toDF("a", "low_a"), "a").join(low.toDF("b", "low_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, k) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return both.select("a", "b", "low_a", "low_b").mapInArrow(run, "a long, b long")


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """rep and z, the compressed text, of about the wanted reps. ``wanted``: rep.

    A bitmap of fixed size keeps most other texts out of the shuffles that follow; whatever it lets
    through is dropped by the joins.
    """
    held = texts.sparkSession.sparkContext.broadcast(bitmap(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            take = batch.filter(pa.array(lit_up(held.value, batch.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([take.column(0), pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in take.column(1).to_pylist()], pa.binary())], names=["rep", "z"])

    return texts.where(F.col("rep").isNotNull() & F.col("text").isNotNull()).select("rep", "text", spot("rep").alias("at")).mapInArrow(run, "rep long, z binary")


def _unpressed(z: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")


def confirmed(pairs: DataFrame, texts: DataFrame, spec: NearDupSpec) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. ``texts``: rep and text."""
    held = wanted_texts(texts, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    both = pairs.join(held.toDF("b", "z_b"), "b").join(held.toDF("a", "z_a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for batch in batches:
            keep = []
            for za, zb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if za != last[0]:
                    last = (za, shingles(_unpressed(za), spec.width))
                x, y = last[1], shingles(_unpressed(zb), spec.width)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= spec.percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "z_a", "z_b").mapInArrow(run, "a long, b long").distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and the smallest node that each one reaches by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def _forests(links: DataFrame, tasks: int, most: int) -> DataFrame:
    """node and label of the links (a, b) that each of ``tasks`` tasks holds, by themselves. A task keeps one
    row a node between blocks of ``most`` links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= most:
                held, waiting, n = forest(*map(np.concatenate, zip(held, *waiting, strict=True))), [], 0
        nodes, least = forest(*map(np.concatenate, zip(held, *waiting, strict=True)))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(least[i : i + (1 << 16)])], names=["node", "label"])

    return links.select("a", "b").coalesce(tasks).mapInArrow(run, "node long, label long")


def components(links: DataFrame, links_a_task: int = 1 << 20) -> DataFrame:
    """node and component (its smallest node) of every node of ``links`` (a, b; cut, as they are read twice).

    Tasks of about ``links_a_task`` links first find the components of their own links, which leaves at
    most one link a node and task; where one task holds all links, these are the result. Otherwise each
    round hooks every root to its smallest neighbouring root, follows the hooks to their ends by
    pointer jumping, and carries the links over to the new roots. Hooks along smallest neighbours
    form no cycles but pairs, of which the smaller node stays a root, so a root with a link left merges
    with another in every round: the rounds are at most the logarithm of the nodes, whatever their order.
    """
    tasks = -(-links.count() // links_a_task) or 1
    own = _anew(_forests(links, tasks, links_a_task))
    if own.rdd.getNumPartitions() <= 1:
        return own.withColumnRenamed("label", "component")
    edges = own.select(F.col("node").alias("a"), F.col("label").alias("b")).where("a <> b")
    edges = _anew(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = _anew(own.select("node").distinct().withColumn("label", F.col("node")))
    while edges.take(1):
        roots = _hooked(edges)
        labels = _anew(labels.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        moved = edges.join(roots.toDF("a", "x"), "a").select("b", "x").join(roots.toDF("b", "y"), "b")
        edges = _anew(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


def _anew(df: DataFrame) -> DataFrame:
    """``cut`` for loops: the estimated sizes are forgotten too, which joins would multiply from round to
    round to numbers of millions of digits."""
    spark, done = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False), spark)


def _hooked(edges: DataFrame) -> DataFrame:
    """node and root of every node of ``edges`` (a, b, in both directions, none to itself)."""
    up = _anew(edges.groupBy("a").agg(F.min("b").alias("up")).toDF("node", "up"))
    above = lambda: up.toDF("up", "top")
    up = _anew(up.join(above(), "up").select("node", F.when((F.col("top") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("up")))
    while True:
        now = _anew(up.join(above(), "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        up = now.select("node", "up")
        if not now.where("moved").take(1):
            return up


def class_links(classes: DataFrame, texts: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Links (a, b) that connect exactly the classes that are connected by all confirmed pairs.

    The joins on places are merge joins of two plain exchanges, so adaptive execution can split the
    places of large groups over tasks.
    """
    posted = postings(classes, spec)
    lists = posted.groupBy("place").agg(F.max(F.struct("mass", (-F.col("rep")).alias("r"))).alias("top"), F.count("*").alias("n")).where("n > 1")
    lists = cut(lists.select("place", (-F.col("top.r")).alias("hub"), "n"))
    posted = cut(posted.select("place", "rep").join(lists.hint("merge"), "place"))
    first = posted.where("rep <> hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    tried = cut(colliding(first, classes, spec))
    links = cut(confirmed(tried, texts, spec))

    labels = components(links)
    marked = cut(posted.join(labels.toDF("rep", "c"), "rep", "left").select("place", "rep", F.coalesce("c", "rep").alias("c"), "n"))
    second = cut(_short_lists(marked.where(F.col("n") <= spec.short), spec).union(_long_lists(marked.where(F.col("n") > spec.short), texts, spec)).distinct())
    fresh = cut(colliding(second.join(tried, ["a", "b"], "left_anti"), classes, spec))
    return cut(links.union(confirmed(fresh, texts, spec)))


def _short_lists(marked: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs across components in lists of at most ``short`` members."""
    x, y = marked.select("place", F.col("rep").alias("a"), F.col("c").alias("ca")), marked.select("place", F.col("rep").alias("b"), F.col("c").alias("cb"))
    return x.join(y.hint("merge"), "place").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _long_lists(marked: DataFrame, texts: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs across components, of members of longer lists, that may be similar enough by their rare shingles.

    Shingles that the same sets hold are one place, so a shared passage brings a pair up once and not with
    each of its shingles. At the rarest common shingle nothing before it is common, which bounds what two
    sets share.
    """
    mixed = cut(marked.groupBy("place").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("place"))
    open_ = cut(marked.join(mixed.hint("merge"), "place").select("rep", "c").distinct())
    rare = cut(rare_shingles(cut(open_.join(wanted_texts(texts, open_.select("rep")), "rep").select("rep", "c", "z")), spec))
    members = [F.bit_xor(F.xxhash64("rep", F.lit(i))).alias(f"g{i}") for i in range(2)]
    # cut, so that the join has two plain exchanges and a place of a large group can be split over tasks
    lists = cut(rare.groupBy("place").agg(*members, F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("place", "g0", "g1"))
    met = rare.join(lists.hint("merge"), "place").groupBy("g0", "g1", "rep").agg(F.first("c").alias("c"), F.first("n").alias("n"), (F.first("n") - F.min("i")).alias("most"))
    return _close_pairs(cut(met), spec)


def _close_pairs(met: DataFrame, spec: NearDupSpec) -> DataFrame:
    """Pairs across components that the bounds leave, without trying all pairs of a list. ``met``: list
    (g0, g1), rep, c, n and most, what the set can share with another one that it meets there.

    Of two similar sets the smaller one can share as much as sets of its own size must; sets that cannot
    (the weak ones) never meet each other. Members of a list's largest component never meet each other
    either, and only neighbouring bands of sizes meet.
    """
    need, have = spec.percent, 100 + spec.percent
    sizes = met.groupBy("g0", "g1", "c").count().groupBy("g0", "g1").agg(F.max(F.struct("count", "c")).alias("top"))
    band = F.floor(F.log("n") / float(np.log(105 / need)))
    held = cut(met.join(sizes.hint("merge"), ["g0", "g1"]).select("g0", "g1", "rep", "c", "n", "most", band.alias("band"), (F.col("c") != F.col("top.c")).alias("other"), (have * F.col("most") >= 2 * need * F.col("n")).alias("strong")))
    x = held.select("g0", "g1", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band"), F.col("rep").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"), "strong")
    y = held.select("g0", "g1", "band", F.col("rep").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"), "other", F.col("strong").alias("strong_b"))
    close = (F.col("ca") != F.col("cb")) & (have * F.least("ma", "mb") >= need * (F.col("na") + F.col("nb")))

    def met_by(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right.hint("merge"), ["g0", "g1", "band"]).where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    return met_by(x, y.where("other and strong_b")).union(met_by(x.where("strong"), y.where("other and not strong_b"))).distinct()


def rare_shingles(docs: DataFrame, spec: NearDupSpec) -> DataFrame:
    """place, rep, c, n and i: the rarest shingles of each set of ``n``, as many as it may lose and still
    be similar enough to another set, and one more, without those that no other set holds; ``i`` of the
    set are rarer. ``docs``: rep, c and z."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        return [shingles(_unpressed(z), spec.width) for z in column.to_pylist()]

    shared = counted(docs.select("z"), lambda batch: np.concatenate(sets(batch.column(0)))).withColumnRenamed("n", "m")
    held = docs.sparkSession.sparkContext.broadcast(low_bits(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = sets(part.column(2))
                took = [s[seen(held.value, s)] for s in found]
                rep, c, n = (np.repeat(np.asarray(v), [len(s) for s in took]) for v in (part.column(0).to_numpy(), part.column(1).to_numpy(), [len(s) for s in found]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(took).view(np.int64)), pa.array(rep), pa.array(c), pa.array(n)], names=["place", "rep", "c", "n"])

    rows = docs.select("rep", "c", "z").mapInArrow(run, "place long, rep long, c long, n long").join(shared.hint("merge"), "place")
    whole, ordered = Window.partitionBy("rep"), Window.partitionBy("rep").orderBy("m", "place")
    ranked = rows.withColumn("i", F.col("n") - F.count("*").over(whole) + F.row_number().over(ordered) - 1)
    keep = F.floor((100 - spec.percent) * F.col("n") / 100) + 1
    return ranked.where(F.col("i") < keep).select("place", "rep", "c", "n", "i")


def _low_bytes(sig: str, k: int) -> Column:
    """The first byte (the lowest) of each 4-byte value, natively."""
    digits = F.hex(sig)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.substring(digits, i * 8 + 1, F.lit(2))), ""))


def near_dups(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row. ``docs``: doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = cut(signed(docs, spec))
    classes = cut(rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    classes = classes.withColumn("low", _low_bytes("sig", spec.coordinates))
    links = class_links(classes, docs.toDF("rep", "text"), spec)
    labels = components(links)
    named = classes.select("set_key", "rep").join(labels.toDF("rep", "c"), "rep", "left").select("set_key", F.coalesce("c", "rep").alias("c"))
    done = rows.drop("sig").join(named, "set_key", "left")
    component = F.coalesce("c", "doc_id")
    return done.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, spec: NearDupSpec = NearDupSpec()) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id; all columns stay.

    Rows with a null id stay; of rows that repeat an id and its text one stays.
    """
    found = cut(near_dups(docs, spec))
    left = docs.join(found.where("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1)
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


def op1_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_near_dups": op1_near_dups}
ORACLE_SQL: dict[str, str] = {}
