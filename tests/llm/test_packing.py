import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallyweave.llm import packing as K

from .helpers import odd_docs, prose


def texts(rng):
    out = [prose(rng, rng.choice([1, 5, 40, 300, 3000])) for _ in range(120)]
    return [*out, None, "", "<|endoftext|> and <|endoftext|>", "日本語 text", "tab\x1cx", "a" * 5000, out[0]]


def check(rows, limit=2048):
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
    padding = 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at and n > 0
            at += n
        assert at <= limit
        padding += 0 if at & (at - 1) == 0 else limit - at
    for pieces in docs.values():
        at = 0
        for s, n, total in sorted(pieces):
            assert s == at
            at += n
        assert at == pieces[0][2]
    return padding


def test_pieces_cover_every_id_once(spark):
    tokenizers = pytest.importorskip("tokenizers")
    files = K.default_files()
    whole = tokenizers.Tokenizer.from_file(files[0])
    said = texts(random.Random(1))
    rows = K.pack(odd_docs(spark, list(enumerate(said))), *files).collect()
    assert check(rows) == 0
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(said)}
    assert {r.doc_id for r in rows} == set(ids)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_limits_of_all_three_kinds():
    rng = random.Random(2)
    spec = K.PackSpec(max_tokens=100, max_segments=4, max_loss=60, window=16)
    packer, items, out = K.Packer(spec), {}, []
    for key in range(300):
        n = rng.randint(1, 180)
        items[key] = (n, rng.randint(0, n))
        out += packer.add(key, *items[key])
    out += packer.finish()
    covered, bins = defaultdict(list), defaultdict(list)
    for key, start, n, seq, offset in out:
        covered[key].append((start, n))
        bins[seq].append((key, n, offset))
    for key, (n, _) in items.items():
        at = 0
        for s, k in sorted(covered[key]):
            assert s == at
            at += k
        assert at == n
    for pieces in bins.values():
        assert sum(n for _, n, _ in pieces) <= 100 and len(pieces) <= 4
        # the share of loss that falls on a piece is rounded up at each cut
        assert sum(items[k][1] * n / items[k][0] for k, n, _ in pieces) <= 60 + 4


def test_whole_examples_when_they_may_not_be_cut():
    packer = K.Packer(K.PackSpec(max_tokens=50, window=8, splittable=False))
    out = [p for key in range(40) for p in packer.add(key, 7 + key % 30)] + list(packer.finish())
    assert sorted(k for k, *_ in out) == list(range(40)) and all(s == 0 for _, s, *_ in out)
    with pytest.raises(ValueError):
        list(packer.add(99, 51))


def test_empty_table(spark):
    assert K.pack(odd_docs(spark, []), *K.default_files()).collect() == []


def test_a_column_of_loss_bearing_tokens_binds(spark):
    """Half of each example bears loss, so a sequence of 64 tokens at a limit of 20 holds about 40; segments bind too."""
    rows = [(i, "word " * (3 + i % 9), 2 + i % 5) for i in range(300)] + [(900, None, None), (901, "a b", 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, answer long")
    out = K.pack(docs, *K.default_files(), spec=K.PackSpec(max_tokens=64, max_segments=5, max_loss=20, window=32), loss="answer").collect()
    check(out, 64)
    bears = {r.doc_id: (min(dict((i, a or 0) for i, _, a in rows)[r.doc_id], r.doc_tokens), r.doc_tokens) for r in out}
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append(r)
    lost = [sum(bears[r.doc_id][0] * r.length / bears[r.doc_id][1] for r in b) for b in bins.values()]
    assert max(lost) <= 20 + 5 and max(len(b) for b in bins.values()) == 5
    assert sum(x > 15 for x in lost) > 10  # the limit binds
    free = K.pack(docs, *K.default_files(), spec=K.PackSpec(max_tokens=64, max_segments=5, window=32)).collect()
    assert len({r.sequence_id for r in free}) < len(bins)
