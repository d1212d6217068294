import random
import re
from collections import Counter

import pytest

from tallyweave.llm import suffix_dedup as S

from .helpers import odd_docs


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                cover[i : i + length] = b"\1" * length
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out.append((len(d), sum(cover), spans, bytes(c for c, x in zip(d, cover) if not x)))
    return out


def got(spark, texts, spec):
    df = S.remove_repeats(odd_docs(spark, list(enumerate(texts))), spec)
    return [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def corpus(seed, n=40):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice("abcdeé \n") for _ in range(k))
    shared = [piece(rng.randint(20, 150)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(piece(rng.randint(0, 60)) + (rng.choice(shared)[rng.randint(0, 10) :] if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 5)))
        texts.append(t)
    return [*texts, *texts[:5], None, "", "x" * 300, "ab" * 200, shared[0] + shared[0], "x" * 39]


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 7))]
        out = list(S.merge([S.front_code(r) for r in runs]))
        assert [x[3] for x in out] == sorted(s for r in runs for s in r)
        for a, b in zip(out, out[1:]):
            assert S.common(a[3], b[3], 0) == b[2]
        assert all(runs[r][i] == s for r, i, _, s in out)


def test_anchors_do_not_depend_on_chunks(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"abc ") for _ in range(4000))
    spec = S.RepeatSpec(length=40, gram=8)
    whole = [x.tolist() for x in S.anchors(data, spec)]
    monkeypatch.setattr(S, "CHUNK", 100)
    assert [x.tolist() for x in S.anchors(data, spec)] == whole


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removal_matches_brute_force(spark, seed):
    texts = corpus(seed)
    assert got(spark, texts, S.RepeatSpec(length=40, gram=8, bucket=50)) == brute(texts, 40)


def test_frequent_grams_are_counted_by_window(spark):
    texts = corpus(4)
    assert got(spark, texts, S.RepeatSpec(length=40, gram=8, hot=2)) == brute(texts, 40)


def test_many_contexts_of_one_gram(spark):
    rng = random.Random(6)
    core = "".join(rng.choice("abcdefgh") for _ in range(30))
    texts = ["".join(rng.choice("uvwxyz") for _ in range(60)) + rng.choice(["", "zz", "yy"]) + core + rng.choice(["qq", "rr", "s"]) * rng.randint(1, 30) for _ in range(80)]
    assert got(spark, texts, S.RepeatSpec(length=40, gram=8)) == brute(texts, 40)


def test_empty_table_and_null_ids(spark):
    assert S.remove_repeats(odd_docs(spark, [])).collect() == []
    t = "abcdefghij" * 41
    rows = S.remove_repeats(odd_docs(spark, [(None, t[:405]), (None, "short"), (1, t[:405])])).collect()
    assert sorted(r.n_removed for r in rows) == [0, 405, 405]


def brute_passages(texts, k):
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(w for d in data for w in {tuple(d[i : i + k]) for i in range(len(d) - k + 1)})
    out = []
    for d in data:
        cover = [0] * len(d)
        for i in range(len(d) - k + 1):
            if seen[tuple(d[i : i + k])] > 1:
                cover[i : i + k] = [1] * k
        out.append((sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1])), sum(cover)))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 20_000), (2, 20_000), (3, 2)])
def test_passages_match_brute_force(spark, seed, hot, monkeypatch):
    rng = random.Random(seed)
    piece = lambda k: "".join(rng.choice(["a", "bé", "the", "longerword", "x y"]) + rng.choice([" ", "\n", " \t "]) for _ in range(k))
    shared = [piece(rng.randint(8, 30)) for _ in range(5)]
    texts = ["".join(piece(rng.randint(0, 12)) + (rng.choice(shared) if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 4))) for _ in range(40)]
    texts += [texts[0], None, "", "and " * 40, shared[0] * 2, (own := " ".join(f"own{i}" for i in range(15))) + " x " + own + " y " + own[5:], "﻿" + shared[1]]
    spec = S.RepeatSpec(length=10 * S.CODE, gram=3 * S.CODE, bucket=50, hot=hot, words=True, across=True)
    docs = odd_docs(spark, list(enumerate(texts)))
    keys = {(r.k1, r.k2): r.k1 for r in S._keyed(docs).collect()}
    found = {keys[r.k1, r.k2]: (r.n_passages, r.n_passage_words) for r in S.repeated_passages(docs, spec).collect()}
    assert [found.get(i, (0, 0)) for i in range(len(texts))] == brute_passages(texts, 10)
    assert found
    data = " ".join(filter(None, texts)).encode()
    whole = S.word_codes(data)
    assert len(whole) == S.CODE * len(data.split())
    monkeypatch.setattr(S, "CHUNK", 50)
    assert S.word_codes(data) == whole


def test_query_counts_passages_under_400_bytes(spark, tmp_path):
    rng = random.Random(8)
    words = lambda n, c: " ".join(rng.choice(c) + str(rng.randrange(10**3)) for _ in range(n))
    passage, short = words(51, "p"), words(50, "s")
    texts = [words(30, "a") + " " + passage + "\n" + words(9, "b"), passage + " " + words(70, "c"), words(5, "d") + " " + short, short + " " + words(5, "e"), words(90, "f"), None]
    assert len(passage) < 400
    spark.createDataFrame([*enumerate(texts), (None, passage), (None, passage)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = S.op8_suffix_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_words) for r in rows if r.doc_id is not None} == {0: (0, 1, 51), 1: (0, 1, 51), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (0, 0, 0)}
    assert [(r.n_passages, r.n_passage_words) for r in rows if r.doc_id is None] == [(1, 51)] * 2
