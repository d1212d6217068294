"""Citibank rows whose amounts stand on other lines."""

from tallyweave.operators import parse_rows as P

TEXT = "\n".join(["01/05 01/06 ACME STORE 01/07 01/08 BIG SHOP", "page header", "$12.50 and $3.00", "$1,007.25", "02/01 02/02 CAFE ROW $8.00", *["x"] * 7, "01/09 01/10 LATE ONE 01/11 01/12 NO AMOUNT"])


def test_crammed_lines_take_each_amount_once(spark):
    pages = spark.createDataFrame([(1, TEXT), (2, TEXT.replace("$1,007.25", "")), (3, None), (4, "x\n" * 30 + "$9.00\n" + "x\n" * 11 + "01/05 01/06 FAR 01/07 01/08 AWAY")], "doc_id long, text string")
    rows = P.parse(pages, "Citibank", 2025).collect()
    first = [(0, "2025-01-05", "ACME STORE", "12.50"), (0, "2025-01-07", "BIG SHOP", "3.00"), (4, "2025-02-01", "CAFE ROW", "8.00")]
    shown = lambda d: sorted((r.pos, str(r.txn_date), r.description, str(r.amount)) for r in rows if r.doc_id == d)
    assert shown(1) == sorted([*first, (12, "2025-01-09", "LATE ONE", "1007.25")])
    assert shown(2) == sorted(first)
    assert not shown(3) and not shown(4)
    assert [r.type for r in rows if r.kind == "crammed"] == ["debit"] * 5
