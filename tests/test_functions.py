import datetime as dt


from rfmlens.functions import days_between, format_currency, sample_skewness, slug
from rfmlens.operators.scoring import quintile_edges, quintile_score, tier


def test_currency_goldens(spark):
    cases = [(0.0, "$0"), (0.5, "$0"), (2.5, "$2"), (999.4, "$999"), (999.5, "$1,000"), (1000.0, "$1.0K"),
             (-1500.0, "$-1.5K"), (12345.6, "$12.3K"), (999999.0, "$1,000.0K"), (1000000.0, "$1.00M"),
             (2675000.0, "$2.67M"), (1234567890.0, "$1,234.57M"), (None, "$0")]
    df = spark.createDataFrame([(v,) for v, _ in cases], "v DOUBLE")
    got = [r[0] for r in df.select(format_currency("v", "$")).collect()]
    assert got == [e for _, e in cases]


def test_quintiles_and_tier(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10, 101, 10)], "x DOUBLE")
    edges = quintile_edges(df, "x")
    got = [r[0] for r in df.orderBy("x").select(quintile_score("x", edges)).collect()]
    assert got == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    flat = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,), (9.0,)], "x DOUBLE")
    assert quintile_edges(flat, "x") is None
    t = spark.createDataFrame([(12,), (11,), (7,), (6,), (None,)], "t INT")
    assert [r[0] for r in t.select(tier("t")).collect()] == ["High Value", "Mid Value", "Mid Value",
                                                             "Low Value", None]


def test_skewness_and_day_floor(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x DOUBLE")
    assert abs(df.select(sample_skewness("x")).first()[0] - 1.763632614803888) < 1e-12
    d = spark.createDataFrame([(dt.datetime(2020, 1, 1, 23), dt.datetime(2020, 1, 3, 22))],
                              "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    assert d.select(days_between("a", "b")).first()[0] == 1


def test_slug(spark):
    df = spark.createDataFrame([(" Order-No ",), ("cust_id",)], "c STRING")
    assert [r[0] for r in df.select(slug("c")).collect()] == ["orderno", "custid"]
