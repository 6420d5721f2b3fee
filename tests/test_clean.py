import datetime as dt

from rfmlens.operators.clean import clean_transactions, nonzero_report
from rfmlens.operators.rfm import compute_rfm

DIRTY = [
    (0, " C1 ", "I1", "2024-01-01", "2", "10"),
    (1, "C1", "I1", "2024-01-03", None, "5"),
    (2, "C1", "I2", "garbage", "4", None),
    (3, "nan", "I3", "2024-01-02", "1", "7"),
    (4, "C2", "", "2024-01-05", "-1", "3"),
    (5, "C2", "I5", "2024-01-04", "abc", "4"),
    (6, "C3", "I6", "2024-01-06", "x", "8"),
    (7, "C4", "I7", None, "3", "0"),
]
SCHEMA = "row_id INT, customer_id STRING, invoice_id STRING, invoice_date STRING, quantity STRING, unit_price STRING"


def test_dirty_fixture(spark):
    df = spark.createDataFrame(DIRTY, SCHEMA)
    clean, report = clean_transactions(df, row_id_col="row_id")
    rows = {r["row_id"]: r for r in clean.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 6]
    assert rows[0]["customer_id"] == "C1" and rows[0]["line_total"] == 20
    assert rows[1]["quantity"] == 3 and rows[1]["line_total"] == 15
    assert rows[2]["invoice_date"] == dt.datetime(2024, 1, 4) and rows[2]["unit_price"] == 7.5
    assert rows[2]["line_total"] == 30
    assert rows[3]["customer_id"] == "CUST_3"
    assert rows[6]["quantity"] == 2 and rows[6]["line_total"] == 16
    rep = {(r["section"], r["key"]): r["value"] for r in report.collect()}
    assert rep[("rows", "original_rows")] == 8 and rep[("rows", "clean_rows")] == 5
    assert rep[("imputed", "customer_id")] == 1 and rep[("imputed", "invoice_id")] == 1
    assert rep[("imputed", "invoice_date")] == 2 and rep[("imputed", "quantity")] == 3
    assert rep[("imputed", "unit_price")] == 1
    assert rep[("dropped", "negative_quantity")] == 2 and rep[("dropped", "zero_price")] == 1
    assert nonzero_report(report).count() == 7
    rfm = {r["customer_id"]: (r["Recency"], r["Frequency"], r["Monetary"])
           for r in compute_rfm(clean, snapshot="2024-01-07").collect()}
    assert rfm == {"C1": (3, 2, 65.0), "C3": (1, 1, 16.0), "CUST_3": (5, 1, 7.0)}


def test_absent_roles(spark):
    df = spark.createDataFrame([("u1", "5.0"), ("u2", "-1"), ("u1", "2")], "user STRING, value STRING")
    clean, report = clean_transactions(df)
    rows = sorted((r["customer_id"], r["invoice_id"], r["unit_price"]) for r in clean.collect())
    assert rows == [("u1", "u1_20230601", 2.0), ("u1", "u1_20230601", 5.0)]
    rep = {(r["section"], r["key"]): r["value"] for r in report.collect()}
    assert rep[("imputed", "invoice_id")] == 3 and rep[("imputed", "quantity")] == 3
    assert rep[("dropped", "zero_price")] == 1 and ("dropped", "negative_quantity") not in rep


def test_properties_no_nulls(spark):
    import random
    rnd = random.Random(7)
    data = [(i, rnd.choice(["a", "b", None, "nan"]), rnd.choice(["x", None]),
             rnd.choice(["2024-02-01", "bad", None, "3/4/2024 10:00"]),
             rnd.choice(["1", "2", None, "0", "q"]), rnd.choice(["1.5", None, "-2", "3"]))
            for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    clean, report = clean_transactions(df, row_id_col="row_id")
    r = clean.selectExpr("count(*) n", "count_if(customer_id is null or invoice_id is null or "
                         "invoice_date is null or quantity is null or unit_price is null) nulls",
                         "min(quantity) q", "min(unit_price) p").first()
    assert r["nulls"] == 0 and (r["n"] == 0 or (r["q"] > 0 and r["p"] > 0))
    rep = {(x["section"], x["key"]): x["value"] for x in report.collect()}
    dropped = sum(v for (s, _), v in rep.items() if s == "dropped")
    assert rep[("rows", "original_rows")] - dropped == rep[("rows", "clean_rows")] == r["n"]


def test_only_rows_in_need_move_to_their_medians(spark, monkeypatch):
    from rfmlens.operators import clean
    monkeypatch.setattr(clean, "BROADCAST_MEDIANS", 0)
    rows = [(f"c{i % 7}", str(i), "2011-01-01", None if i % 11 == 0 else str(i % 5 + 1), "x" if i % 13 == 0 else "2.5") for i in range(300)]
    df = spark.createDataFrame(rows, "customer string, invoice string, date string, qty string, price string")
    lines, _ = clean.clean_transactions(df)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count() == 300 and "Join" not in plan
