import random

import numpy as np

from tallyweave.llm import language_id, quality_knn, toxicity

from .helpers import odd_docs, prose

WORDS = {"en": "the of and to in that with are this from".split(), "fr": "le la les des une que pour dans était ça".split()}


def say(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    docs = [(i, say(rng, "en" if i % 2 else "fr", rng.randint(5, 60))) for i in range(200)]
    model = language_id.train(odd_docs(spark, docs))
    fresh = [(i, say(rng, "en" if i % 2 else "fr", 20)) for i in range(60)] + [(900, None), (901, ""), (902, "12 + 7"), (903, "the of " * 40_000), (None, "les des"), (3, "the of and")]
    out = language_id.predict(odd_docs(spark, fresh), model).collect()
    assert len(out) == len(fresh) and all(0 <= r.score <= 1 for r in out)
    got = {r.doc_id: r.lang_pred for r in out}
    assert all(got[i] == ("en" if i % 2 else "fr") for i in range(60))
    assert [got[i] for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"]


def test_ftrl_matches_the_plain_rule_step_by_step():
    spec = language_id.LanguageSpec(bits=4, epochs=2)
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(16, 4, replace=False)), rng.random(4) * 3) for _ in range(12)]
    y, k = rng.integers(0, 3, 12), 3
    got, bias = language_id.ftrl(rows, y, k, spec)
    z, n = {}, {}

    def weight(key, l1):
        a, b = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(a) <= l1 else -(a - (1 if a > 0 else -1) * l1) / ((spec.beta + b**0.5) / spec.alpha + spec.l2)

    order = np.random.default_rng(7)
    for _ in range(spec.epochs):
        for i in order.permutation(len(rows)):
            x = {**{(int(f), c): v for f, v in zip(*rows[i], strict=True) for c in range(k)}, **{("bias", c): 1.0 for c in range(k)}}
            w = {key: weight(key, 0.0 if key[0] == "bias" else spec.l1) for key in x}
            s = [sum(v * w[key] for key, v in x.items() if key[1] == c) for c in range(k)]
            e = [np.exp(v - max(s)) for v in s]
            for key, v in x.items():
                g = v * (e[key[1]] / sum(e) - (key[1] == y[i]))
                rate = ((n.get(key, 0.0) + g * g) ** 0.5 - n.get(key, 0.0) ** 0.5) / spec.alpha
                z[key], n[key] = z.get(key, 0.0) + g - rate * w[key], n.get(key, 0.0) + g * g
    assert np.allclose(got, [[weight((f, c), spec.l1) for c in range(k)] for f in range(16)])
    assert np.allclose(bias, [weight(("bias", c), 0.0) for c in range(k)])


def test_the_fitting_sample_ends_whole(spark):
    rng = random.Random(6)
    rows = odd_docs(spark, [(i, say(rng, "en" if i % 2 else "fr", 30)) for i in range(60)]).where("lang is not null")
    every = language_id.fit_sample(rows, {"en": 30, "fr": 30}, language_id.LanguageSpec())
    few = language_id.fit_sample(rows, {"en": 30, "fr": 30}, language_id.LanguageSpec(fit_terms=600))
    assert len(every) == 60 and 2 <= len(few) < 60
    whole = {(lang, h): (idx.tolist(), tf.tolist()) for lang, h, idx, tf in every}
    assert all(whole[lang, h] == (idx.tolist(), tf.tolist()) for lang, h, idx, tf in few)


def test_language_without_rows(spark):
    model = language_id.train(odd_docs(spark, [(1, None)]))
    assert [r.lang_pred for r in language_id.predict(odd_docs(spark, [(1, "some text")]), model).collect()] == ["und"]
    assert language_id.predict(odd_docs(spark, []), model).collect() == []


def test_temperature_is_that_of_least_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=r) for r in p])
    assert 0.85 < language_id.fit_temperature(z * 4, y) / 4 < 1.2


def quality_docs(rng, n):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        t = prose(rng, 80)
        docs.append((i, t if good else t.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    return docs, labels


def test_quality(spark):
    rng = random.Random(2)
    docs, labels = quality_docs(rng, 150)
    known = spark.createDataFrame(labels[:100], "doc_id long, quality int")
    rows = odd_docs(spark, [*docs, (900, None), (901, ""), (None, "plain words here")])
    model = quality_knn.train(rows, known)
    done = quality_knn.attach(rows, model, score="found").collect()
    got = {r.doc_id: r.found for r in done}
    assert len(done) == 153 and all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels[100:])
    assert got[900] == got[901] == model.prior


def test_quality_votes_are_exact_cosines():
    rng = np.random.default_rng(3)
    m = quality_knn.QualityModel(np.ones(quality_knn.SIZE, np.float32), rng.normal(size=(quality_knn.SIZE, 8)).astype(np.float32), quality_knn.unit(rng.normal(size=(50, 8)).astype(np.float32)), rng.integers(0, 2, 50).astype(float), np.ones(50), 0.5, 5)
    counts = np.stack([quality_knn.term_counts(t) for t in ("some text", "other words", "Third One!")])
    for c, s in zip(counts, m.score(counts)):
        x = quality_knn.unit(quality_knn.tf_idf(c[None], m.idf) @ m.basis)[0]
        sims = np.maximum(m.vectors @ x, 1e-6)
        near = np.argsort(-(m.vectors @ x))[:5]
        assert abs(s - (sims[near] * m.labels[near]).sum() / sims[near].sum()) < 1e-6


def test_terms_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(4)
    t = prose(rng, 300) + "\n word word  twice\ttwice é " + "x" * 90
    whole = quality_knn.term_counts(t)
    words = t.lower().split()
    assert whole[quality_knn.PAIRS :].sum() == 2 * len(words) - 1
    assert whole[quality_knn.REPEATED] == sum(len(a.encode()) + 1 for a, b in zip(words, words[1:], strict=False) if a == b)
    monkeypatch.setattr(quality_knn, "BLOCK", 128)
    assert (quality_knn.term_counts(t) == whole).all()


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_knn.train(odd_docs(spark, [(1, "a b")]), none)
    assert [r.found for r in quality_knn.attach(odd_docs(spark, [(1, "a b")]), model, score="found").collect()] == [0.5]
    empty = quality_knn.train(odd_docs(spark, []), spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert quality_knn.attach(odd_docs(spark, []), empty, score="found").collect() == []


def toxic_docs(rng, n):
    docs, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        s = [prose(rng, 10) for _ in range(6)]
        if bad:
            s[rng.randrange(6)] += " " + rng.choice(["foulword", "nastything", "vileterm"])
        docs.append((i, ". ".join(s)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity(spark):
    rng = random.Random(3)
    docs, labels = toxic_docs(rng, 600)
    rows = odd_docs(spark, [*docs, (9000, None), (9001, ""), (None, "some words")])
    model = toxicity.train(rows, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    out = {r.doc_id: r for r in toxicity.attach(rows, model).collect()}
    assert len(out) == 603
    right = [(out[i].score >= 0.5) == bool(y) for i, y in labels[400:]]
    assert sum(right) / len(right) > 0.98
    for i, y in labels[400:]:
        if y and out[i].score >= 0.5:
            said = dict(docs)[i][out[i].worst_start : out[i].worst_end]
            assert any(w in said for w in ("foulword", "nastything", "vileterm"))
    assert out[9000].score == out[9001].score < 0.5


def test_noisy_or_gradient_by_differences():
    rng = np.random.default_rng(8)
    bags = [(np.sort(rng.integers(0, 3, 5)), rng.integers(0, 4, 5)) for _ in range(9)]
    y, prior, spec = np.array([1.0, 0, 0] * 3), rng.random(4), toxicity.ToxicSpec(bias=-1.0)

    def loss(w):
        total = 0.0
        for (s, f), v in zip(bags, y, strict=True):
            none = toxicity.FLOOR + sum(np.logaddexp(0, spec.bias + w[f[s == i]].sum()) for i in set(s.tolist()))
            total += -v * np.log(-np.expm1(-none)) + (1 - v) * none
        return total / len(y) + spec.pull / 2 * ((w - prior) ** 2).sum() / len(y)

    w, step = rng.random(4), 1e-6
    g = toxicity.gradient(toxicity._flat(bags), y, w, prior, spec)
    for i in range(4):
        up = w.copy()
        up[i] += step
        assert abs((loss(up) - loss(w)) / step - g[i]) < 1e-4


def test_the_instances_decide_and_not_the_prior():
    """A word that stands in toxic and in clean bags beside one that explains the toxic ones loses its weight."""
    bags = [(np.array([0, 1]), np.array([0, 1]))] * 30 + [(np.array([0]), np.array([1]))] * 60
    y, prior = np.array([1.0] * 30 + [0.0] * 60), np.array([2.0, 2.0])
    w = toxicity.fit_noisy_or(bags, y, prior, toxicity.ToxicSpec())
    assert w[0] > 3.0 and w[1] < 1.0


def test_a_limit_on_pairs_leaves_whole_rows(spark):
    found = spark.createDataFrame([(i * 77777, [1] * 5) for i in range(200)], "h long, f array<int>")
    rows = toxicity._within(found, 300).collect()
    assert 0 < sum(len(r.f) for r in rows) <= 300 and toxicity._within(found, 1000).count() == 200


def test_toxicity_without_labels(spark):
    model = toxicity.train(odd_docs(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.attach(odd_docs(spark, [(1, "a")]), model).collect()] == [0.5]
    assert toxicity.attach(odd_docs(spark, []), model).collect() == []
