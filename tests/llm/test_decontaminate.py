import hashlib
import random
import re

from tallyweave.llm import decontaminate as D

from .helpers import odd_docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            found = windows.setdefault(tuple(w[k : k + n]), set())
            if i is not None:
                found.add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    ids |= found
        out.append((i is None, i or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n, v=12: " ".join(rng.choice(["a", "Bb", "c1", "é", "d-e", "F"][: v]) for _ in range(n))
    items = [(i, say(rng.randint(0, 16))) for i in range(25)] + [(3, "x"), (None, "y z " * 8), (77, None)]
    docs = [(i, say(rng.randint(0, 60)) + " " + (items[rng.randrange(25)][1] if rng.random() < 0.5 else "")) for i in range(60)]
    return [*docs, (900, None), (901, ""), (902, "x"), (2, "Y z " * 8), (None, items[4][1])], items


def run(spark, docs, items, spec):
    out = D.report(odd_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"), spec)
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect())


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        one, items = D.SuffixAutomaton(4), [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 9))] for _ in range(5)]
        for i, w in enumerate(items):
            one.add(w, str(i))
        one.seal()
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)]
        hit, ids = set(), set()
        for i, w in enumerate(items):
            for k in range(max(1, len(w) - 3)) if w else []:
                q = w[k : k + 4]
                for j in range(len(text) - len(q) + 1):
                    if text[j : j + len(q)] == q:
                        hit.update(range(j, j + len(q)))
                        ids.add(str(i))
        runs, found = one.hits(text)
        assert {x for s, e in runs for x in range(s, e)} == hit and found == ids


def test_report_matches_brute_force(spark):
    docs, items = corpus(1)
    assert run(spark, docs, items, D.DecontaminationSpec()) == brute(docs, items)


def test_blocks_of_the_benchmark_add_up(spark):
    docs, items = corpus(2)
    assert run(spark, docs, items, D.DecontaminationSpec(max_words=60)) == brute(docs, items)


def test_remove(spark):
    item = " ".join(f"w{i}" for i in range(10))
    docs = odd_docs(spark, [(1, f"Before it, {item.upper()}! After it all."), (2, item), (3, None), (4, "clean")])
    out = D.remove(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[1] == "Before it, ! After it all." and 2 not in kept and kept[3] is None and kept[4] == "clean"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(spark, [(1, "a b")], [], D.DecontaminationSpec())[0][3] == 0
    assert D.report(odd_docs(spark, []), none).collect() == []
