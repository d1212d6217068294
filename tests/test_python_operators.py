"""The ledger operators that SQL cannot express, against plain Python."""

import random

from pyspark.sql import functions as F

from tallyweave import rules
from tallyweave.functions import features
from tallyweave.operators import categorise as C
from tallyweave.operators import ledger as L
from tallyweave.operators import parse_rows as P


def best_match(a, b, reach):
    """The largest number of one-to-one pairs within reach, by trying all of them."""
    if not a or not b:
        return 0
    rest = best_match(a[1:], b, reach)
    return max([rest, *[1 + best_match(a[1:], b[:j] + b[j + 1 :], reach) for j in range(len(b)) if abs(a[0] - b[j]) <= reach]])


def test_greedy_matching_finds_the_largest_matching(spark):
    rng = random.Random(1)
    docs = {d: ([rng.randint(100, 106) for _ in range(rng.randint(0, 5))], [rng.randint(100, 106) for _ in range(rng.randint(0, 5))]) for d in range(40)}
    df = lambda side: spark.createDataFrame([(d, c / 100) for d, both in docs.items() for c in both[side]], "doc_id long, amount double").select("doc_id", F.col("amount").cast("decimal(18,2)"))
    got = {r.doc_id: r.matched for r in L.tolerance_match(df(0), df(1)).collect()}
    assert got == {d: best_match(a, b, 1) for d, (a, b) in docs.items() if a or b}


def test_generic_rows(spark):
    page = "Statement\n01/08/2025 ACME STORE GA $12.50\n01/09 no money\nTotal fees 01/10 3.00\n01/11/25 ATM fee -4.00"
    got = [(str(r.txn_date), r.description, str(r.amount)) for r in P.generic(spark.createDataFrame([(1, page)], "doc_id long, text string")).orderBy("pos").collect()]
    assert got == [("2025-01-08", "Acme Store", "12.50"), ("2025-01-11", "Atm Fee", "-4.00")]


def test_proposals_come_in_batches(spark):
    sizes = []
    rows = spark.createDataFrame([(i, f"shop {i}", float(i)) for i in range(45)], "seq long, description string, amount double").coalesce(1)

    def client(batch):
        sizes.append(len(batch))
        assert len(batch) <= 20
        return [f"{d}:{a:g}" for d, a in batch]

    assert {r.seq: r.proposed for r in C.batch_proposals(rows, client).collect()} == {i: f"shop {i}:{i}" for i in range(45)}
    assert {r.proposed for r in C.batch_proposals(rows, None).collect()} == {None}


def test_fuzzy_names_are_those_of_the_plain_function(spark):
    said = ["Office Suplies", "utilities", "zebra", None, "", "Insurance "]
    names = list(rules.CATEGORIES)
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*said, *said])], "seq long, said string")
    got = {r.seq: r.out for r in C.fuzzy_names(rows, "said", names, "out").collect()}
    assert got == {i: C.closest(s, names) for i, s in enumerate([*said, *said])}


POOR_LAST = [[0.9, 1.0], [0.5, 0.9], [0.0, 0.6], [0.1, 0.2]]


def test_weights_adapt_record_by_record(spark, monkeypatch):
    rng = random.Random(5)
    runs = {p: [rng.choice(level) for level in levels for _ in range(n)] for p, n, levels in (("a", 2, POOR_LAST), ("b", 12, POOR_LAST), ("c", 40, POOR_LAST[::-1]), ("d", 14, POOR_LAST[1:]), ("e", 12, POOR_LAST[::-1]))}
    want = {}
    for p, values in runs.items():
        w = dict(rules.PARSER_WEIGHTS)
        for i in range(10, len(values) + 1):
            mean = sum(values[i - 10 : i]) / 10
            if mean < 0.5:
                w["ai_weak"] = min(0.8, w["ai_weak"] + 0.1)
                w["ai_plain"] = 1 - w["ai_weak"]
                w["confidence"] = max(0.1, w["confidence"] - 0.05)
                w["money_rate"], w["date_rate"] = min(0.4, w["money_rate"] + 0.05), min(0.3, w["date_rate"] + 0.05)
            elif mean > 0.8:
                w["confidence"] = min(0.5, w["confidence"] + 0.02)
        want[p] = w
    assert len({round(w["confidence"], 6) for w in want.values()}) > 2
    history = spark.createDataFrame([(p, i, v or None, 9) for p, values in runs.items() for i, v in enumerate(values)], "parser string, at long, success double, i int")
    monkeypatch.setattr(features, "FOLD", 8)
    got = {r.parser: r.asDict() for r in features.adapted_weights(history).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[p][k] - v) < 1e-9 for p, w in want.items() for k, v in w.items())
    assert features.adapted_weights(history.limit(0)).collect() == []


def test_clusters_keep_every_line_and_split_unlike_ones(spark):
    lines = [(1, i, f"01/{i % 28 + 1:02d} SHOP NUMBER {i} $1{i % 10}.00" if i % 2 else "some heading without figures") for i in range(40)]
    out = features.cluster_lines(spark.createDataFrame(lines, "doc_id long, line long, text string"), k=2).collect()
    assert len(out) == 40
    by = lambda odd: {r.cluster for r in out if r.line % 2 == odd}
    assert not by(0) & by(1)
