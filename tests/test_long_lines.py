"""Lines of more than 500 characters: Citibank's alone are left out."""

import pytest

from tallyweave.operators import parse_rows as P

LONG = "SHOP " * 120
LINES = {
    "Navy Federal": f"01-08 {LONG}12.50 100.00",
    "Capital One": f"01/08 01/09 {LONG}$12.50",
    "Bank of America": f"01/08/25 {LONG}-12.50",
    "Chase": f"01/08 {LONG}12.50",
    "Citibank": f"01/08 01/09 {LONG}$12.50",
}


@pytest.mark.parametrize("bank", LINES)
def test_long_lines(spark, bank):
    short = LINES[bank].replace(LONG, "SHOP ")
    rows = P.parse(spark.createDataFrame([(1, short), (2, LINES[bank])], "doc_id long, text string"), bank, 2025).collect()
    assert len(LINES[bank]) > 500
    assert {r.doc_id: str(r.amount) for r in rows} == ({1: "12.50"} if bank == "Citibank" else {1: "12.50", 2: "12.50"})
