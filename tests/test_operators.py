"""Edge cases of the ledger operators, each against its rule."""

import datetime as dt
import json
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from tallyweave import rules
from tallyweave.functions import dates, money, text
from tallyweave.operators import categorise as C
from tallyweave.operators import geometry as G
from tallyweave.operators import ledger as L
from tallyweave.operators import parse_rows as P
from tallyweave.operators import reconcile as R
from tallyweave.operators import validate as V
from tallyweave.sources import documents, files, ocr
from tallyweave.streaming import ledger as ST

ROWS = "doc_id long, seq long, txn_date date, date_raw string, description string, amount decimal(18,2), page int, line_top double, account string, running_balance decimal(18,2)"


def rows(spark, *given):
    """(doc, description, amount, ...) with defaults for the rest."""
    out = []
    for i, g in enumerate(given):
        out.append((g.get("doc", 1), i, g.get("date"), g.get("raw", ""), g.get("d", "x"), None if g.get("a") is None else Dec(g["a"]), g.get("page", 1), float(i), g.get("acct"), None if g.get("b") is None else Dec(g["b"])))
    return spark.createDataFrame(out, ROWS)


TOKENS = {  # token: stated, word, row, validated
    "$1,234.56": ("1234.56",) * 4, "(96.12)": ("-96.12",) * 4, "12.34-": (None, "-12.34", None, None), "-12.3": ("-12.30",) * 4, "+18.67": ("18.67",) * 4, "12": ("12.00",) * 4, "": (None,) * 4, None: (None,) * 4,
    "= $5.00": ("5.00", None, None, None), "1 234.50": (None, None, "1234.50", None), "abc": (None,) * 4, "()": (None,) * 4, "-": (None,) * 4,
}


def test_money_dialects(spark):
    df = spark.createDataFrame([(t,) for t in TOKENS], "t string").select("t", *[f(F.col("t")).alias(n) for n, f in (("a", money.stated), ("b", money.word), ("c", money.row), ("d", money.validated))])
    for r in df.collect():
        assert tuple(None if x is None else str(x) for x in r[1:]) == TOKENS[r.t], r.t


def test_dates_never_fail(spark):
    said = ["02/30/2024", "01/08/25", "01/08/2025", "13/01/2025", "2025-01-08", "01-08-2025", "2/3", "", None, "junk", "99/99/99"]
    got = spark.createDataFrame([(s,) for s in said], "t string").select(dates.base(F.col("t"), F.lit(2024)).alias("a"), dates.validated(F.col("t")).alias("b")).collect()
    day = dt.date(2025, 1, 8)
    assert [r.a for r in got] == [None, day, day, dt.date(2025, 1, 13), day, day, dt.date(2024, 2, 3), None, None, None, None]
    assert [r.b for r in got][6] is None
    long_ago = spark.createDataFrame([("01/02/70",), ("01/02/68",)], "t string").select(dates.base(F.col("t")).alias("a")).collect()
    assert [r.a.year for r in long_ago] == [1970, 2068]


def test_chain(spark):
    df = rows(
        spark, {"doc": 1, "a": "1.00"}, {"doc": 2, "a": "1.00", "b": "5.00"}, {"doc": 3, "a": "1.00", "b": "5.00"}, {"doc": 3, "a": "2.00", "b": "7.00"},
        {"doc": 4, "a": "1.00", "b": "5.00", "acct": "a"}, {"doc": 4, "a": "9.00", "b": "50.00", "acct": "b"}, {"doc": 4, "a": "2.00", "b": "7.01", "acct": "a"}, {"doc": 4, "a": "1.00", "b": "51.02", "acct": "b"}, {"doc": 4, "a": None, "b": "51.02", "acct": "b"},
    )
    got = {r.doc_id: r for r in R.chain(df).collect()}
    assert set(got) == {3, 4}
    assert (got[3].matched_rows, got[3].checked_rows, got[3].first_break) == (1, 1, None)
    # one cent off passes, two cents do not; accounts do not mix
    assert (got[4].matched_rows, got[4].checked_rows, str(got[4].drift), got[4].first_break) == (2, 3, "0.02", 7)


STATED = "doc_id long, " + ", ".join(f"{f} decimal(18,2)" for f in rules.TOTAL_FIELDS)


def stated(spark, **by_doc):
    return spark.createDataFrame([(int(k[1:]), *[Dec(v[f]) if f in v else None for f in rules.TOTAL_FIELDS]) for k, v in by_doc.items()], STATED)


def test_verdicts_and_their_tolerance(spark):
    df = rows(spark, *[{"doc": d, "a": a} for d in range(1, 8) for a in ("10.00", "-4.00")], {"doc": 9, "a": "1.00", "b": "1.00"}, {"doc": 9, "a": "1.00", "b": "2.00"})
    totals = stated(
        spark, d1={"charges": "10.01"}, d2={"charges": "10.02"}, d3={"deposits": "10.00", "withdrawals": "-4.01"}, d4={"new_balance": "108.00", "previous_balance": "100.00", "interest": "1.50", "fees": "0.50"},
        d5={"ending_balance": "6.00"}, d6={}, d7={"withdrawals": "5.00"}, d8={"charges": "0.00"}, d9={"ending_balance": "2.00"},
    )
    got = {r.doc_id: r for r in R.reconcile(df, totals).collect()}
    assert [(got[d].check_type, got[d].reconciled, str(got[d].discrepancy), got[d].confidence) for d in range(1, 10)] == [
        ("charges_total", True, "-0.01", 95.0), ("charges_total", False, "-0.02", 40.0), ("deposits_withdrawals", True, "0.01", 95.0), ("balance_equation", True, "0.00", 85.0), ("ending_balance_only", False, "0.00", 20.0),
        ("none", False, "0.00", 0.0), ("deposits_withdrawals", False, "1.00", 40.0), ("charges_total", True, "0.00", 95.0), ("running_balance_chain", True, "0.00", 95.0),
    ]


def test_totals_prefer_long_labels_and_skip_the_year(spark):
    page = "New Balance\nTotal fees charged in 2025 $71.53\n$4,932 New balance $3,673.63\nTotal fees for this period (9.10)\ntotal fees 1.00\nPrevious Balance = +$5.00"
    r = R.stated_totals(spark.createDataFrame([(1, page), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert str(r[0].new_balance) == "3673.63" and str(r[0].fees) == "9.10" and str(r[0].previous_balance) == "5.00"
    assert r[1].fees is None and r[2].fees is None


def test_repair_is_a_multiset_difference(spark):
    found = rows(spark, {"a": "5.00"}, {"a": "-5.00"}, {"a": "7.00"})
    said = rows(spark, {"a": "5.00"}, {"a": "5.00"}, {"a": "-5.00"}, {"a": "-7.00"}, {"a": "9.00"}, {"a": None})
    assert sorted(r.seq for r in R.repair_diff(found, said).collect()) == [2, 4, 5]


def test_three_kinds_of_duplicates(spark):
    two = rows(spark, {"d": "Shop 1", "a": "5.00", "raw": "2025-01-08", "date": dt.date(2025, 1, 8)}, {"d": "SHOP-1", "a": "5.00", "raw": "2025-02-08", "date": dt.date(2025, 2, 8)}, {"d": "shop1", "a": "-5.00", "raw": "01/08/2025", "date": dt.date(2025, 1, 8)})
    # an ISO date's month key is the end of its year, so two months collapse
    assert [r.seq for r in L.dedupe_filter(two).orderBy("seq").collect()] == [0, 2]
    assert [r.seq for r in L.dedupe_month(two).orderBy("seq").collect()] == [0, 1]
    assert L.dedupe_pipeline(two).count() == 3
    dateless = rows(spark, *[{"d": "a", "a": "1.00", "page": p} for p in (1, 1, 1, 2, 2)])
    assert [r.seq for r in L.dedupe_filter(dateless).orderBy("seq").collect()] == [0, 1, 3]


WORDS = "doc_id long, page int, word_id long, text string, x0 double, x1 double, top double, bottom double"


def words(spark, *given):
    return spark.createDataFrame([(1, g[4] if len(g) > 4 else 1, i, g[0], float(g[1]), float(g[2]), float(g[3]), float(g[3]) + 8) for i, g in enumerate(given)], WORDS)


def test_lines_measure_from_their_first_word(spark):
    w = words(spark, ("a", 0, 1, 0), ("b", 0, 1, 2), ("c", 0, 1, 4), ("d", 9, 10, 100))
    by = lambda df: [r.line for r in df.orderBy("word_id").collect()]
    assert by(G.lines(w, 3.0)) == [1, 1, 2, 3]
    assert by(G.lines_by_gap(w, 3.0)) == [1, 1, 1]
    assert by(G.lines_by_bucket(w, 2.0)) == [1, 1, 2, 3]


def test_bucket_lines_need_no_join_and_keep_each_word_once(spark):
    same = [(None, 1, 7, t, 0.0, 1.0, y, y + 8) for t, y in (("a", 0.0), ("b", 1.0), ("c", 50.0))]
    found = G.lines_by_bucket(spark.createDataFrame(same, WORDS), 2.0)
    assert sorted((r.doc_id, r.page, r.word_id, r.text, r.top, r.line) for r in found.collect()) == [(None, 1, 7, "a", 0.0, 1), (None, 1, 7, "b", 1.0, 1), (None, 1, 7, "c", 50.0, 2)]
    assert G.lines_by_bucket(words(spark, ("b", 0, 1, 2)).union(words(spark, ("a", 0, 1, 0)))).count() == 2
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(("edges", "want"), [([(473, 3)], (473.0, None)), ([(473, 4), (594, 4)], (473.0, 594.0)), ([(300, 2), (473, 5), (594, 6)], (473.0, 594.0)), ([(473, 1)], None), ([(100, 3), (200, 3), (300, 3)], (100.0, 200.0))])
def test_columns(spark, edges, want):
    w = words(spark, *[("1.00", x - 20, x, 12 * (i + k * 20)) for k, (x, n) in enumerate(edges) for i in range(n)])
    got = [(r.amount_x1, r.balance_x1) for r in G.columns(w).collect()]
    assert got == ([want] if want else [])


def test_raw_rows(spark):
    line = lambda top, *ws: [(t, x0, x1, top) for t, x0, x1 in ws]
    w = words(
        spark, *line(0, ("Flagship", 10, 50), ("Checking", 60, 90), ("-", 92, 94), ("7145495045", 100, 160)), *line(20, ("Jan", 30, 45), ("8", 48, 52), ("CORNER", 80, 120), ("SHOP", 125, 150), ("12.34", 440, 473), ("100.00", 560, 594)),
        *line(40, ("01/09", 30, 50), ("AUTOPAY", 80, 120), ("50.00", 440, 473), ("50.00", 560, 594)), *line(60, ("New", 80, 100), ("Balance", 105, 140), ("99.00", 440, 473)), *line(80, ("01/10", 30, 50), ("two", 80, 90), ("1.00", 440, 473), ("2.00", 441, 474)),
        *line(100, ("01/11", 30, 50), ("9.00", 440, 473)), *line(120, ("01/12", 30, 50), ("5.00", 80, 120), ("9.00", 440, 473)),
    )
    lined = G.lines(w)
    plan = spark.createDataFrame([(1, 1, 473.0, 594.0)], "doc_id long, page int, amount_x1 double, balance_x1 double")
    got = [(r.date_raw, r.description, str(r.amount), None if r.running_balance is None else str(r.running_balance), r.account) for r in G.raw_rows(lined, plan).orderBy("line").collect()]
    head = "Flagship Checking - 7145495045"
    assert got == [("Jan 8", "CORNER SHOP", "12.34", "100.00", head), ("01/09", "AUTOPAY", "-50.00", "50.00", head), ("01/11", "(no description)", "9.00", None, head)]


def test_categories_in_order(spark):
    df = rows(spark, {"d": "VERIZON WIRELESS tax"}, {"d": "qtip store"}, {"d": "uber eats delivery"}, {"d": "new balance"}, {"d": "zzz"}, {"d": ""}, {"d": None}, {"d": "payment for rent"})
    got = [(r.category, r.source) for r in C.categorise(df).orderBy("seq").collect()]
    assert got[0] == ("Utilities", "learned") and got[1] == (rules.TRAVEL, "learned") and got[2] == (rules.MEALS, "keyword")
    assert got[3] == got[4] == got[5] == got[6] == (rules.DEFAULT_CATEGORY, "default") and got[7] == ("Banking & Credit", "keyword")
    assert C.learned_category(F.lit("petro stop"), (("petro", "No Such"),)) is not None
    assert df.select(C.learned_category(F.lit("petro stop"), (("petro", "No Such"),)).alias("c")).first().c is None


def test_closest_names():
    names = list(rules.CATEGORIES)
    assert C.closest(" Office Supplies ", names) == "Office Supplies" and C.closest("utilities", names) == "Utilities"
    assert C.closest("Office Suplies", names) == "Office Supplies" and C.closest("zebra", names) is None and C.closest(None, names) is None


def test_every_error_code_and_both_thresholds(spark):
    day = dt.date(2025, 1, 1)
    df = rows(
        spark, {"d": "good shop", "a": "5.00", "date": day}, {"d": "good shop", "a": "5.00", "date": day}, {"d": None, "a": None}, {"d": "ab", "a": "0.00", "date": dt.date(2025, 3, 1)}, {"d": "old null", "a": "5.00", "date": dt.date(2010, 1, 1)}, {"d": "huge", "a": "2000000.00", "date": day},
    )
    v = V.validate(df, "2025-01-01")
    got = {r.seq: r for r in v.collect()}
    assert got[0].errors == [] and got[0].quality_score == 90.0 and got[1].errors == ["duplicate"] and got[1].is_valid
    assert got[2].errors == ["missing_date", "missing_description", "missing_amount"] and not got[2].is_valid and got[2].quality_score == 0.0
    assert got[3].errors == ["future_date", "short_description", "zero_amount"] and got[3].n_warnings == 3
    assert got[4].errors == ["ancient_date"] and got[4].n_warnings == 2 and got[5].errors == ["huge_amount"] and not got[5].is_valid
    assert V.accepted(v).count() + V.rejected(v).count() == 6 and V.accepted(v, 20.0).count() >= V.accepted(v, 30.0).count()


def test_descriptions(spark):
    said = {"CHECKCARD 0412 UBER TRIP 8005928996 CA": "UBER TRIP", "": "", "12/27": "12/27", "SARALANDAL": "Saraland AL", "#12 AWS x": "#12 AWS X", None: ""}
    df = spark.createDataFrame([(s,) for s in said], "t string").select("t", text.normalized(F.col("t")).alias("n"))
    got = {r.t: r.n for r in df.collect()}
    assert got[""] == "" and got[None] == "" and got["12/27"] == "12/27" and got["#12 AWS x"] == "#12 AWS X"
    assert got["CHECKCARD 0412 UBER TRIP 8005928996 CA"] == "UBER TRIP"  # short capitals stay


def test_parsers_are_taken_in_order(spark):
    pages = spark.createDataFrame([(1, "01/08/25 X 12.00\n01/09 SHOP 5.00\n01/10 BACK -3.00\nPLAIN LINE 7.00")], "doc_id long, text string")
    got = [(r.kind, r.description, str(r.amount)) for r in P.parse(pages, "Chase", 2025).orderBy("pos").collect()]
    assert got == [("dated", "X", "12.00"), ("dated", "SHOP", "5.00"), ("dateless", "PLAIN LINE", "7.00")] or got[1] == ("dated", "SHOP", "5.00")
    assert ("dateless", "PLAIN LINE", "7.00") in got and all(a != "-3.00" for _, _, a in got)


def test_boxes(spark):
    v = spark.createDataFrame([(1, "a b", 0.1, 0.8, 0.2, 0.1, 1000, 1000, 72)], "doc_id long, text string, norm_x double, norm_y double, norm_w double, norm_h double, img_w int, img_h int, dpi int")
    got = [(r.text, round(r.x0, 6), round(r.x1, 6), round(r.top, 6), round(r.bottom, 6)) for r in ocr.vision_words(v).orderBy("part").collect()]
    assert got == [("a", 100.0, 200.0, 100.0, 200.0), ("b", 200.0, 300.0, 100.0, 200.0)]
    t = spark.createDataFrame([("x", c, 10.0, 20.0, 30.0, 40.0, 144) for c in ("-1", "29", "30", "n/a")], "text string, conf string, left double, top double, width double, height double, dpi int")
    assert ocr.tesseract_words(t).count() == 3


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿Date,Description,Amount\n2025-01-01,a,USD 5.00\n2025-01-02,,x\n2025-01-03,b,-7\n", encoding="utf-8")
    assert [(r.date, r.description, str(r.amount)) for r in files.truth_csv(spark, str(tmp_path / "t.csv")).orderBy("date").collect()] == [("2025-01-01", "a", "5.00"), ("2025-01-03", "b", "-7.00")]
    (tmp_path / "l.json").write_text(json.dumps([{"date": "2025-01-01", "description": "a", "amount": 5.25}, {"description": None}]))
    assert sorted(str(r.amount) for r in files.labels_json(spark, str(tmp_path / "l.json")).collect()) == ["0.00", "5.25"]
    (tmp_path / "p.txt").write_text("# no\nf|a+|3|x|y|z\nonly\ng|b\n")
    assert sorted(tuple(r) for r in files.patterns(spark, str(tmp_path / "p.txt")).collect()) == [("f", "a+", 3, "x|y|z"), ("g", "b", 1, "")]
    assert files.categories_json(spark).count() == sum(map(len, rules.CATEGORIES.values()))


def test_document_source(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello there\nyou\fpage two")
    (tmp_path / "b.bin").write_text("?")
    documents.register(spark)
    read = lambda p: spark.read.format("statement_documents").option("path", str(tmp_path)).option("projection", p).load()
    assert [(r.page, r.text) for r in read("pages").orderBy("page").collect()] == [(1, "Hello there\nyou"), (2, "page two")]
    assert [(r.text, r.x0, r.top) for r in read("words").orderBy("word_id").collect()] == [("Hello", 0.0, 0.0), ("there", 36.0, 0.0), ("you", 0.0, 12.0), ("page", 0.0, 0.0), ("two", 30.0, 0.0)]


def test_streams(spark, tmp_path):
    now = dt.datetime(2025, 1, 1)
    seen = spark.createDataFrame([("f", now), ("f", now + dt.timedelta(hours=1)), ("g", now)], "fingerprint string, seen_at timestamp")
    seen.write.parquet(str(tmp_path / "in"))
    stream = ST.file_drop(spark, str(tmp_path / "in"), seen.schema)
    q = ST.remember_formats(stream, str(tmp_path / "known"), str(tmp_path / "c1"))
    q.awaitTermination()
    assert {r.fingerprint: r.seen_count for r in spark.read.parquet(str(tmp_path / "known/batch=0")).collect()} == {"f": 2, "g": 1}
    chain = rows(spark, {"a": "1.00", "b": "5.00", "acct": "x"}, {"a": "2.00", "b": "7.00", "acct": "x"}, {"a": "2.00", "b": "9.50", "acct": "x"}).select("account", "seq", F.col("amount").cast("double"), F.col("running_balance").cast("double"))
    chain.write.parquet(str(tmp_path / "rows"))
    out = ST.running_chain(ST.file_drop(spark, str(tmp_path / "rows"), chain.schema))
    q = out.writeStream.outputMode("update").format("memory").queryName("chain_out").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT account, max(checked), max(matched) FROM chain_out GROUP BY account").collect()] == [("x", 2, 1)]
    q = ST.without_reuploads(stream).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_empty_tables(spark):
    none = rows(spark).limit(0)
    assert R.reconcile(none, stated(spark)).count() == 0 and L.dedupe_filter(none).count() == 0 and C.categorise(none).count() == 0 and V.validate(none, "2025-01-01").count() == 0
    assert G.columns(words(spark).limit(0)).count() == 0
