import random
import re

import numpy as np

from tallyweave.llm import near_dups as N

from .helpers import edited, odd_docs, prose


def words(t):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs]
    comp = {i: i for i, _ in sets if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                comp[max(x, y)] = min(x, y)
    return {(i, len(s), find(i) if i is not None else None) for i, s in sets}


def got(spark, docs, spec=N.NearDupSpec()):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in N.near_dups(odd_docs(spark, docs), spec).collect()}


def test_shingles_are_those_of_the_words():
    for t in ["A b  c\td e F", "x", " ", "", None, "one two three four", "É b c d e f é", "a b c d e a b c d e", "\x0ba\x0cb \x85c"]:
        assert len(N.shingles(t)) == len(shingle_set(t))
    assert len(np.intersect1d(N.shingles("A b c d e"), N.shingles("a  B\nc d E"))) == 1


def test_long_texts_are_read_in_chunks(monkeypatch):
    rng = random.Random(5)
    t = prose(rng, 3000)
    whole = N.shingles(t)
    monkeypatch.setattr(N, "CHUNK", 64)
    assert (N.shingles(t) == whole).all()


def test_components_match_brute_force(spark):
    rng = random.Random(1)
    docs, base = [], [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    common = prose(rng, 60)
    for i, t in enumerate(base):
        docs.append((len(docs) + 3, t + " " + common if i % 4 == 0 else t))
        for _ in range(rng.randint(0, 4)):
            docs.append((len(docs) + 3, edited(rng, t, rng.choice([0.0, 0.01, 0.03, 0.05, 0.08]))))
    docs += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "a b"), (9004, "A  b"), (9004, "A  b"), (None, "a b"), (None, None)]
    rng.shuffle(docs)
    found = got(spark, docs)
    want = brute(docs)
    assert {x for x in found if x[0] is not None} == {x for x in want if x[0] is not None}


def test_a_large_group_of_near_copies_goes_through_the_long_lists(spark):
    rng = random.Random(2)
    t = prose(rng, 150, 600)
    docs = [(i, edited(rng, t, 0.02 + 0.03 * (i % 3))) for i in range(60)]
    assert got(spark, docs, N.NearDupSpec(short=4)) == brute(docs)


def test_components_of_shuffled_chains_settle(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 4000)
    chains = [ids[:3000], ids[3000:3990], ids[3990:]]
    links = [tuple(sorted(x)) for c in chains for x in zip(c, c[1:])] + [(2_000_000, 2_000_000)]
    rng.shuffle(links)
    table = spark.createDataFrame(links, "a long, b long").repartition(8)
    for a_task in (1 << 20, 1000, 100):
        got = {r.node: r.component for r in N.components(table, a_task).collect()}
        assert got == {i: min(c) for c in chains for i in c} | {2_000_000: 2_000_000}


def test_forests_of_blocks_are_those_of_all_links(spark):
    rng = random.Random(4)
    links = [tuple(rng.sample(range(3000), 2)) for _ in range(1400)]
    least, one = N.forest(*np.array(links).T), N._forests(spark.createDataFrame(links, "a long, b long"), 1, 100)
    assert {(r.node, r.label) for r in one.collect()} == set(zip(*map(np.ndarray.tolist, least)))
    sets = {i: {i} for link in links for i in link}
    for a, b in links:
        sets[a] |= sets[b]
        for i in sets[a]:
            sets[i] = sets[a]
    assert dict(zip(*map(np.ndarray.tolist, least))) == {i: min(s) for i, s in sets.items()}


def test_components_of_no_links(spark):
    assert N.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    assert N.near_dups(odd_docs(spark, [])).collect() == []


def test_keep_one_keeps_all_columns_and_one_of_each_group(spark):
    docs = odd_docs(spark, [(5, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (8, "x y"), (None, "a b c d e f")])
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 8), (True, 0)]
