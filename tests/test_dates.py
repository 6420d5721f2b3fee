import datetime as dt

from pyspark.sql import types as T

from rfmlens.operators.clean import clean_transactions
from rfmlens.operators.dates import date_format_table, dates, readings, settled


def _read(spark, values, order=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, d string")
    parts = readings(df["d"], T.StringType())
    return [r[0] for r in df.orderBy("i").select(dates(*parts, order)).collect()]


def test_readings(spark):
    d = dt.datetime
    texts = ["2011-02-03", "2011-02-03T04:05:06", "2011/02/03 04:05", "3.2.2011", "3 Feb 2011", "25/12/2010 8:26", "12/25/2010", " 02/03/2011 ",
             "2-3-2011 4:05:06", "30/02/2011", "13/13/2011", "02/03-2011", "1/2/11", "", None, "garbage", "2011-02-30"]
    common = [d(2011, 2, 3), d(2011, 2, 3, 4, 5, 6), d(2011, 2, 3, 4, 5), d(2011, 2, 3), d(2011, 2, 3), d(2010, 12, 25, 8, 26), d(2010, 12, 25)]
    nothing = [None] * 8
    assert _read(spark, texts, "month_first") == [*common, d(2011, 2, 3), d(2011, 2, 3, 4, 5, 6), *nothing]
    assert _read(spark, texts, "day_first") == [*common, d(2011, 3, 2), d(2011, 3, 2, 4, 5, 6), *nothing]


def test_the_whole_column_settles_the_order(spark):
    df = spark.createDataFrame([("02/03/2011", "02/03/2011", "02/03/2011"), ("13/02/2011", "02/13/2011", "05/06/2011"),
                                ("31/01/2011", "1/2/2011", None)], "a string, b string, c string")
    assert {r["column"]: r["date_order"] for r in date_format_table(df, ["a", "b", "c"]).collect()} == {"a": "day_first", "b": "month_first", "c": "month_first"}
    assert settled({}) is None
    assert date_format_table(df.limit(0), ["a"]).first()["date_order"] is None


def test_cleaner_reads_and_reports_the_order(spark):
    rows = [("c", str(i), d, "1", "1") for i, d in enumerate(["02/03/2011", "25/12/2010 8:26", "2011-05-06", "x"])]
    df = spark.createDataFrame(rows, "customer string, invoice string, date string, qty string, price string")
    lines, report = clean_transactions(df)
    assert {r.invoice_id: r.invoice_date for r in lines.collect()}["0"] == dt.datetime(2011, 3, 2)
    found = [tuple(r) for r in report.where("section = 'date_format'").collect()]
    assert found == [("date_format", "day_first", 2, "d/M/yyyy")]
    assert report.where("section = 'imputed' AND key = 'invoice_date'").first().value == 1
    plain = clean_transactions(df.where("invoice = '2'"))[1]
    assert plain.where("section = 'date_format'").count() == 0


def test_only_texts_of_a_formats_shape_are_tried(spark):
    import re

    from rfmlens.operators.dates import PLAIN
    texts = ["garbage", "3 Feb 2011", "2011/02/03 04:05", "30/02/2011", "x" * 30]
    assert {x: sum(bool(re.fullmatch(shape, x)) for shape in PLAIN.values()) for x in texts} == dict(zip(texts, (0, 1, 1, 0, 0)))
    assert _read(spark, ["29/02/2012", "29/02/2011", "31/04/2011", "1/2/2011 24:00", "29/02/1900", "29/02/2000"], "day_first") == [
        dt.datetime(2012, 2, 29), None, None, None, None, dt.datetime(2000, 2, 29)]


def test_texts_and_dates_in_one_table(spark):
    df = spark.createDataFrame([("02/03/2011", dt.date(2011, 1, 2)), (None, None), ("no", dt.date(2011, 1, 3))], "a string, b date")
    rows = {r["column"]: tuple(r)[1:] for r in date_format_table(df, ["a", "b"]).collect()}
    assert rows == {"a": ("month_first", 0, 1, 0, 0, 1), "b": (None, 2, 0, 0, 0, 0)}
