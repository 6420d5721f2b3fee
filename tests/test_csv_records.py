"""CSV records read in parallel: the same as Spark's one-task reader, with the same numbers for any splits."""

import csv
import io
import os
import random
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from rfmlens.sources.csv_records import csv_records, header_names, quoted_after, read_csv
from rfmlens.sources.readers import csv_options, read_transactions


def _file(text: str, name: str = "a.csv", folder: str | None = None) -> str:
    folder = folder or tempfile.mkdtemp(prefix="rfmlens-csv-")
    path = os.path.join(folder, name)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def _rows(n: int, seed: int) -> list[list[str]]:
    rnd = random.Random(seed)
    cells = ["a", "", 'say "hi"', "two\nlines", "a,b", '"', "\n\n", 'x"y', "é中", " lead", "trail ", ',"', 'three\n\nlines\n"q"']
    return [[str(i), *[rnd.choice(cells) for _ in range(3)]] for i in range(n)]


def _text(rows, end="\n") -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows([["id", "x y", "text", "z"], *rows])
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_reader_of_one_task_for_any_splits(spark, end):
    rows = _rows(400, 1)
    path = _file(_text(rows, end))
    want = [tuple(r) for r in csv_options(spark.read).csv(path).collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "777", "50"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_csv(spark, path, row_id="row").orderBy("row").collect()
            assert [r.row for r in got] == list(range(400))
            assert [tuple(r)[:-1] for r in got] == want
            if size == "50":
                assert read_csv(spark, path).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_several_files_are_numbered_by_path(spark):
    folder = tempfile.mkdtemp(prefix="rfmlens-csv-")
    rows = _rows(30, 2)
    for i, part in enumerate((rows[:11], rows[11:12], [], rows[12:])):
        _file(_text(part), f"part-{i}.csv", folder)
    got = read_csv(spark, folder, row_id="row").orderBy("row").collect()
    assert [(r.row, r.id) for r in got] == [(i, str(i)) for i in range(30)]


def test_odd_texts(spark):
    assert [quoted_after(x, s) for x, s in (('a,"b', False), ('a,"b', True), ('""', True), ('"",', False), ('x"y', False), ('"a""', False), ('', True),
                                            ('"a"b"c,d', False))] == [True, False, True, False, False, True, True, False]
    assert header_names("a,,A,b") == ["a0", "_c1", "A2", "b"]
    blank = _file("﻿id,x\n\n1,a\n\r\n\n2,\"b\n\nc\"\n5\" pipe,d\n3,e,more\n4\n")
    got = read_csv(spark, blank, row_id="row", corrupt_column="bad").orderBy("row").collect()
    assert [(r.row, r.id, r.x) for r in got] == [(0, "1", "a"), (1, "2", "b\n\nc"), (2, '5" pipe', "d"), (3, "3", "e"), (4, "4", None)]
    assert [r.bad is not None for r in got] == [False, False, False, True, True]
    with pytest.raises(ValueError):
        read_csv(spark, blank, row_id="X")
    assert read_csv(spark, _file("")).count() == 0
    only = read_csv(spark, _file("a,b\n"), row_id="n")
    assert only.columns == ["a", "b", "n"] and only.count() == 0
    assert [r.record for r in csv_records(spark, _file("1,2\n3,4"), header=False)[0].orderBy("number").collect()] == ["1,2", "3,4"]


def test_generated_ids_are_the_rows_places(spark):
    from rfmlens.operators.clean import clean_transactions
    lines = [["customer", "invoice", "date", "qty", "price"]]
    lines += [[f"c{i}" if i % 3 else "", f"i{i}" if i % 5 else "null", "2011-01-01", "1", "2"] for i in range(100)]
    out = io.StringIO()
    csv.writer(out).writerows(lines)
    path = _file(out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("134217728", "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_transactions(spark, path, row_id="row")
            got = clean_transactions(df, row_id_col="row")[0].orderBy("row").collect()
            assert [r.customer_id for r in got] == [f"c{i}" if i % 3 else f"CUST_{i}" for i in range(100)]
            assert [r.invoice_id for r in got] == [f"i{i}" if i % 5 else f"INV_{i}" for i in range(100)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_told_at_once_are_those_told_one_by_one():
    from rfmlens.sources.csv_records import CLOSED
    rnd = random.Random(3)
    lines = ["".join(rnd.choice('",a \ré') for _ in range(rnd.randrange(9))) for _ in range(5000)]
    told = pc.match_substring_regex(pa.array(lines), CLOSED).to_pylist()
    assert told == [not quoted_after(x, False) for x in lines]
