import hashlib
import random
import re

import numpy as np

from tallyweave.llm import pii

from .helpers import odd_docs

KINDS = ("email", "ip", "card", "phone")


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        k = int(c) * (1 + i % 2)
        s += k - 9 * (k > 9)
    return s % 10 == 0


def base(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]
    return out


def fuzz(rng):
    bits = ["@", ".", "a", "b1", " ", "-", "+", "12", "255", "256", "4111 1111 1111 1111", "4111111111111111", "x@y.co", "a@b@c.d.e", "1.2.3.4", "1.2.3.4.5.6.7.8", "+1 (202) 555-0101", "é", "\n", "007.0.0.1", "_", "%"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        t = fuzz(rng)
        assert [(KINDS[k], s, e) for k, s, e in pii.base_spans(t)] == base(t), t


def test_long_runs_take_linear_time():
    for t in ("9" * 200_000, "a" * 200_000 + "@", "@" + "a" * 200_000, "1." * 100_000, "0" * 6000 + ".0.0.1"):
        pii.base_spans(t)


def test_report(spark):
    rng = random.Random(8)
    docs = [(i, fuzz(rng)) for i in range(60)] + [(100, None), (101, ""), (5, "mail a@b.co"), (None, "ip 1.2.3.4")]
    rows = odd_docs(spark, docs)
    found = pii.find_spans(rows, pii.fit(rows)).collect()
    assert len(found) == len(docs)
    want = sorted((i is None, i or 0, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base(t or "")).encode()).hexdigest()) for i, t in docs)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in found) == want
    for r in found:
        assert r.n_email + r.n_ip + r.n_card + r.n_phone <= len([x for x in r.spans.split(",") if x])


def test_the_model_adds_spans_with_support_and_not_others(spark):
    docs = [(i, f'the token = "{"%040x" % (i * 7919 + 11**30)}" here') for i in range(40)] + [(100 + i, f"chapter {i} has 12 words, version 1.2") for i in range(40)]
    rows = odd_docs(spark, docs)
    found = {r.doc_id: r.spans for r in pii.find_spans(rows, pii.fit(rows)).collect()}
    assert all(found[i].startswith("secret:") for i in range(40))
    assert all(found[100 + i] == "" for i in range(40))


def test_the_classifier_reads_spans_and_not_votes():
    yes = [pii.span_features(f"call me at 555-010-{i:04d} now", 5, 11, 23) for i in range(20)]
    no = [pii.span_features(f"version 555.010.{i:04d}, chapter", 5, 8, 20) for i in range(20)]
    model = pii.train([*yes, *no], np.array([0.9] * 20 + [0.1] * 20))
    assert model.accepts("call her at 555-010-7777 now", 5, 12, 24) and not model.accepts("version 555.010.7777, page", 5, 8, 20)
    assert not pii.train([], np.zeros(0)).accepts("call her at 555-010-7777 now", 5, 12, 24)


def test_gradient_of_the_classifier_by_differences():
    rng = np.random.default_rng(4)
    rows, soft = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(12)], rng.random(12)
    w, bias = rng.normal(size=6), 0.3

    def loss(w, bias):
        z = np.array([bias + w[f].sum() for f in rows])
        return (np.logaddexp(0, z) - soft * z).sum() + 0.1 / 2 * (w * w).sum()

    g, b = pii.gradient(rows, soft, w, bias, 0.1)
    step = 1e-6
    for i in range(6):
        up = w.copy()
        up[i] += step
        assert abs((loss(up, bias) - loss(w, bias)) / step - g[i]) < 1e-4
    assert abs((loss(w, bias + step) - loss(w, bias)) / step - b) < 1e-4


def test_long_secrets_are_whole(spark):
    secret = lambda n: ("a1B2c3D4/e5F6_g7" * 200)[:n]
    said = [f"{head}{quote}{secret(n)}{quote} end" for n in (129, 2000) for head, quote in (("token=", ""), ('key = ', '"'))]
    for t in said:
        (_, start, end), = pii.wide_spans(t, pii.base_spans(t))
        assert t[start:end] in (secret(129), secret(2000))
    rows = odd_docs(spark, [(i, said[i % 4]) for i in range(40)])
    assert {r.text for r in pii.mask(rows, pii.fit(rows)).collect()} == {"token=<secret> end", 'key = "<secret>" end'}


def test_mask_keeps_columns_and_nulls(spark):
    rows = odd_docs(spark, [(1, "write a@b.co now"), (2, None), (3, "clean")])
    done = pii.mask(rows, pii.SpanModel())
    assert done.columns == rows.columns
    assert {r.doc_id: r.text for r in done.collect()} == {1: "write <email> now", 2: None, 3: "clean"}


def test_empty_table(spark):
    rows = odd_docs(spark, [])
    assert not pii.fit(rows).weights.any()
    assert pii.find_spans(rows, pii.SpanModel()).collect() == []
