from rfmlens.operators.schema import detect_columns, rename_to_canonical, schema_messages

ROLES = ["customer_id", "invoice_id", "invoice_date", "quantity", "unit_price"]


def roles(cols):
    d = detect_columns(cols)
    return [d[r] for r in ROLES]


# FIXTURES.md section 3 (header goldens)
def test_tier1_identity():
    assert roles(ROLES) == ROLES


def test_tier1_spaces():
    assert roles(["Customer ID", "InvoiceNo", "InvoiceDate", "Quantity", "UnitPrice", "Country"]) == \
        ["Customer ID", "InvoiceNo", "InvoiceDate", "Quantity", "UnitPrice"]


def test_slug():
    assert roles(["cust-id", "Order-No", "Order Date", "QTY", "Selling-Price"]) == \
        ["cust-id", "Order-No", "Order Date", "QTY", "Selling-Price"]


def test_missing_roles_events():
    assert roles(["event_id", "ts", "user_id", "event_type", "value", "props"]) == \
        ["user_id", None, None, None, "value"]


def test_tier3_orders_lineitem():
    orders = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    assert roles(orders) == [None, "o_orderkey", "o_orderdate", None, "o_totalprice"]
    li = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    assert roles(li) == [None, "l_orderkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def test_stealing_q4_q5():
    assert roles(["client", "order_date", "qty", "price"]) == ["client", "order_date", None, "qty", "price"]
    assert roles(["user", "date", "unit_price"]) == ["user", None, "date", "unit_price", None]
    assert roles(["customer", "date", "qty", "price"]) == ["customer", None, "date", "qty", "price"]
    assert roles(["customer", "order_id", "date", "discount", "price"]) == \
        ["customer", "order_id", "date", "discount", "price"]
    assert roles(["a", "b", "c"]) == [None] * 5


def test_strict_skips_keywords():
    d = detect_columns(["client", "order_date", "qty", "price"], strict=True)
    assert d["invoice_id"] is None and d["invoice_date"] == "order_date"


def test_messages():
    assert schema_messages(ROLES) == ""
    assert "no column for invoice_id" in schema_messages(["a"])
    assert schema_messages(["customer", "order_id", "date", "qty", "price"]) == ""


def test_duplicate_rename_raises(spark):
    import pytest
    df = spark.createDataFrame([(1, 2)], "`Customer ID` INT, `customer id` INT")
    # both normalise to customer_id -> the later one is chosen, only that is renamed
    out, inferred = rename_to_canonical(df)
    assert out.columns == ["Customer ID", "customer_id"] and inferred == {"customer_id": "customer id"}
    df2 = spark.createDataFrame([(1, 2)], "customer INT, customer_id_x INT")
    out2, _ = rename_to_canonical(df2)
    assert out2.columns[0] == "customer_id"
    df3 = spark.createDataFrame([(1, 2, 3)], "client INT, CLIENT_ID INT, customer_id INT")
    out3, _ = rename_to_canonical(df3)
    assert out3.columns.count("customer_id") == 1
    # Q6: "Customer ID" normalises like the existing customer_id and wins
    df4 = spark.createDataFrame([(1, 2)], "customer_id INT, `Customer ID` INT")
    with pytest.raises(ValueError):
        rename_to_canonical(df4)
