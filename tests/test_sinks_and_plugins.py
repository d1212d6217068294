"""Writers that replace, cap and fill; workbooks; proposals of injected clients; long tails; large rule tables."""

import random
import re

import pytest

from tallyweave import rules
from tallyweave.functions import features, text
from tallyweave.operators import categorise, detect
from tallyweave.sources import files
from tallyweave.sources.workbook import sheets_of, workbook


def test_a_replaced_folder_is_whole_or_the_old_one(spark, tmp_path):
    path = f"{tmp_path}/settings"
    files.replace_atomically(spark.range(3), path, "parquet")
    files.replace_atomically(spark.read.parquet(path).selectExpr("id + 10 as id"), path, "parquet")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    with pytest.raises(Exception):
        files.replace_atomically(spark.range(3).selectExpr("raise_error('no') as id"), path, "parquet")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["settings"]


def test_a_log_keeps_its_newest_half(spark):
    log = spark.createDataFrame([(i, "x" * 9) for i in range(20)], "at int, line string")  # ten bytes each
    fresh = spark.createDataFrame([(99, "new"), (99, None)], "at int, line string")
    at = lambda most: sorted(r.at for r in files.append_capped(log, fresh, most).collect())
    assert at(200) == [*range(20), 99, 99]
    assert at(199) == [*range(11, 20), 99, 99]
    assert at(3) == [99, 99]
    assert [r.at for r in files.append_capped(log.limit(0), fresh, 3).collect()] == [99, 99]


def test_form_data_comes_back(spark, tmp_path):
    rows = [("a.b[0]", "1,200"), ("odd (name)\\", "(5)"), ("none", None), ("empty", "")]
    files.write_form_data(spark.createDataFrame(rows, "name string, shown string"), f"{tmp_path}/form")
    got = files.read_form_data(spark, f"{tmp_path}/form").collect()
    assert sorted((r.name, r.shown) for r in got) == sorted((n, s or "") for n, s in rows)
    files.write_form_data(spark.createDataFrame([], "name string, shown string"), f"{tmp_path}/none")
    assert files.read_form_data(spark, f"{tmp_path}/none").collect() == []


def test_workbooks(spark):
    sheets = [("All", [["a", "b"], ["<&> \" é", 1.5], [None, -3]]), ("all", [["x"]]), ("", [])]
    back = sheets_of(workbook(sheets))
    assert [n for n, _ in back] == ["All", "all_2", "Sheet"]
    assert back[0][1] == [["a", "b"], ["<&> \" é", 1.5], [None, -3.0]]
    assert workbook(sheets) == workbook(sheets)
    rows = spark.createDataFrame([(1, "2025-01-02", "b", 2.0, "Meals / Food"), (1, "2025-01-01", "a", 1.0, "Travel"), (1, None, None, 4.0, None), (2, "2025-01-01", "c", 1.0, "Travel")], "doc_id long, date string, description string, amount double, category string")
    books = {r.doc_id: dict(sheets_of(bytes(r.workbook))) for r in files.workbooks(rows).collect()}
    assert set(books[1]) == {"All Transactions", "Category Summary", "Meals___Food", "Travel", "Uncategorized"}
    assert books[1]["Category Summary"][1:] == [["Meals / Food", 1.0, 2.0], ["Travel", 1.0, 1.0], ["Uncategorized", 1.0, 4.0]]
    assert books[2]["Travel"] == [["date", "description", "amount"], ["2025-01-01", "c", 1.0]]
    assert files.workbooks(rows.limit(0)).collect() == []


def peeled(t):
    """The rule as a plain loop."""
    while True:
        before = t
        for p in (rules.TRAILING_DIGITS, rules.TRAILING_PHONE, rules.TRAILING_STATE):
            t = re.sub(p, "", t)
        t = t.rstrip(" ")
        if t == before:
            return t


def test_tails_are_peeled_to_the_end(spark):
    rng = random.Random(3)
    tails = ["CA", "12345678", "800-922-0204", "555 123 4567 NJ", "123", "12345678901", "X1"]
    said = ["SHOP " + " ".join(rng.choice(tails) for _ in range(rng.randint(0, 30))) for _ in range(200)] + ["", "SHOP" + " CA" * 40, " CA"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*said, None])], "i int, s string").select("i", text.peel_trailing("s").alias("out")).collect()
    got = {r.i: r.out for r in rows}
    assert got.pop(len(said)) is None
    for i, s in enumerate(said):
        assert got[i] == peeled(s), s


def test_rules_of_a_table_of_any_size(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    table = [(f"c{i % 7}", i % 7, w, i) for i, w in enumerate(words)] + [("none", 0, None, 0), ("empty", 0, "", 0), ("late", None, "zzz", 0)]
    said = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(3)) for _ in range(120)] + ["", None, "zzz", "q"]
    rows = spark.createDataFrame([(i // 2, i, s, "x") for i, s in enumerate(said)], "doc_id long, seq long, description string, keyword_rank string")
    out = categorise.keyword_join(rows, spark.createDataFrame(table, "category string, cat_rank int, keyword string, kw_rank int")).collect()
    cleaned = {r.seq: r.t for r in rows.select("seq", text.for_categories(rows.description).alias("t")).collect()}
    assert len(out) == len(said)
    for r in out:
        hits = [(c is None, c if c is not None else 0, k, name) for name, c, w, k in table if w and r.description is not None and w in cleaned[r.seq]]
        assert r.keyword_category == (min(hits)[3] if hits else None), r


def test_answers_of_clients_are_checked(spark):
    def bank(t):
        if "fail" in t:
            raise RuntimeError
        return {"chase": {"bank": " chase bank ", "confidence": "80"}, "odd": {"bank": "Nobody", "confidence": 90}, "high": {"bank": "Chase Bank", "confidence": 900}}.get(t, [])

    known = next(b.bank for b in rules.BRANDS if "chase" in b.bank.lower())
    pages = spark.createDataFrame([(1, 1, "chase"), (2, 1, "odd"), (3, 1, "high"), (4, 1, "fail"), (5, 1, None), (6, 1, "x")], "doc_id long, page int, text string")
    ask = lambda t: {**bank(t), "bank": known} if t == "chase" else bank(t)
    assert [tuple(r) for r in detect.proposed_banks(pages, ask).collect()] == [(1, known, 80.0)]

    def rows(t):
        one = {"date": "2025-01-01", "description": " a ", "amount": "$1,200.50"}
        return {"chase": [one, one, {"date": "", "description": "b", "amount": 1}, {"date": "x", "description": "b", "amount": "n/a"}, 7], "odd": one, "high": None}[t]

    got = detect.proposed_rows(pages, rows).collect()
    assert sorted((r.doc_id, r.page, r.date, r.description, float(r.amount)) for r in got) == [(1, 1, "2025-01-01", "a", 1200.5), (2, 1, "2025-01-01", "a", 1200.5)]


def test_the_best_cluster_is_that_of_the_highest_score(spark):
    lines = [(d, c, f"01/0{i + 1}/2025 STORE PURCHASE ${i}.50" if c == 1 else "page footer") for d in (1, 2) for c in (0, 1) for i in range(4)]
    rows = spark.createDataFrame(lines + [(3, 5, "alone")], "doc_id long, cluster int, text string")
    got = features.best_cluster(rows).select("doc_id", "cluster").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 5)]
