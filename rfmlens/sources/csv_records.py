"""CSV records in parallel, line breaks in quotes included, each with its place in the file.

Spark splits a CSV file among tasks only if no record spans lines. Here a file is read by lines, in splits:

1. every split says what it does to the two states that it may begin in (between records, inside quotes): the state it
   ends in and the records that begin in it, one row a split;
2. the states and counts of the splits before it, added up in file order, are the split's own state and its
   first record's number;
3. a second read cuts the lines into records. One that is whole in its split is a row at once; only pieces of a record that
   crosses a border are brought together. Spark's own CSV parser takes each record apart.

Most lines are whole records. They are told from the others for a batch at once (``CLOSED``), counted and passed on as
columns; only the lines from one that isn't to the next place between records are gone through one by one.

So a record's number is its place in the input (header and empty lines not counted, files by path), the same
for any size of splits, and no line is shuffled but those at borders.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def quoted_after(line: str, quoted: bool) -> bool:
    """Whether the text after a line is inside quotes, given that before it. Quotes count where they open a field;
    inside one, doubled quotes are text."""
    if '"' not in line:
        return quoted
    at = 0
    while True:
        if quoted:
            end = line.find('"', at)
            if end < 0:
                return True
            if line.startswith('"', end + 1):
                at = end + 2
                continue
            quoted = False
            at = end + 1
        elif line.startswith('"', at):
            quoted = True
            at += 1
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at = comma + 1


_FIELD = r'"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|'
#: A line after which the text is between records if it was so before it: ``not quoted_after(line, False)``.
CLOSED = rf"\A(?:{_FIELD})(?:,(?:{_FIELD}))*\z"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, np.ndarray, np.ndarray]]:
    """((file, start), lines, places of those that aren't closed, which are blank) in order; a split may come in several parts."""
    for batch in batches:
        lines, start = batch.column(0), batch.column(2).to_numpy()
        files = pc.dictionary_encode(batch.column(1))
        code = files.indices.to_numpy()
        ends = [*(np.flatnonzero((np.diff(start) != 0) | (np.diff(code) != 0)) + 1).tolist(), len(lines)]
        for i, j in zip([0, *ends], ends):
            if i < j:
                part = lines.slice(i, j - i)
                if start[i] == 0:
                    part = pc.if_else(pc.starts_with(part, "\ufeff"), pc.utf8_slice_codeunits(part, 1), part)
                blank = pc.or_(pc.equal(part, ""), pc.equal(part, "\r")).to_numpy(zero_copy_only=False)
                yield (files.dictionary[code[i]].as_py(), int(start[i])), part, _open(part), blank


def _open(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(~pc.match_substring_regex(lines, CLOSED).to_numpy(zero_copy_only=False))


def _state(lines: pa.Array, opened: np.ndarray, at: int, quoted: bool) -> tuple[int, bool]:
    """(place, state) after the lines that have to be gone through one by one from a place on: between records, all up to the next
    line that isn't closed are passed over."""
    if not quoted:
        k = np.searchsorted(opened, at)
        if k == len(opened):
            return len(lines), False
        at = int(opened[k])
    return at + 1, quoted_after(lines[at].as_py(), quoted)


def _blank(line: str) -> bool:
    return line in ("", "\r")


def _begun(lines: pa.Array, opened: np.ndarray, blank: np.ndarray, quoted: bool) -> tuple[bool, int]:
    """(state after, records begun) of lines."""
    at, n = 0, 0
    while at < len(lines):
        after, state = _state(lines, opened, at, quoted)
        if not quoted:
            n += int(after - at - blank[at:after].sum())
        at, quoted = after, state
    return quoted, n


def _surveyed(lines: DataFrame) -> list[tuple[str, int, list[bool], list[int], str | None]]:
    """(file, start, states after, records begun, the file's first record if it is one line) of each split, the second and third for
    both states before it, in file order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n, top = None, [False, True], [0, 0], None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": at[0], "start": at[1], "out0": state[0], "out1": state[1], "n0": n[0], "n1": n[1], "top": top}], schema)
        for split, lines, opened, blank in _by_split(batches):
            if split != at:
                if at is not None:
                    yield row()
                at, state, n, top = split, [False, True], [0, 0], None
            if top is None and split[1] == 0 and not n[0] and not blank.all():
                head = int(np.flatnonzero(~blank)[0])
                top = lines[head].as_py() if head not in opened else None
            if state[0] == state[1]:
                state[0], more = _begun(lines, opened, blank, state[0])
                state[1], n = state[0], [n[0] + more, n[1] + more]
            else:
                for i in (0, 1):
                    state[i], more = _begun(lines, opened, blank, state[i])
                    n[i] += more
        if at is not None:
            yield row()
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("out0", pa.bool_()), ("out1", pa.bool_()), ("n0", pa.int64()), ("n1", pa.int64()), ("top", pa.string())])
    rows = lines.mapInArrow(run, "file string, start long, out0 boolean, out1 boolean, n0 long, n1 long, top string").collect()
    return [(r["file"], r["start"], [r["out0"], r["out1"]], [r["n0"], r["n1"]], r["top"]) for r in sorted(rows, key=lambda r: (r["file"], r["start"]))]


def csv_records(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, str | None]:
    """(records, header): records are number (from 0) and record (its text); the header is the first file's first record,
    and each file's first record is none of the records."""
    lines = _lines(spark, path)
    splits: dict[tuple[str, int], tuple[bool, int, int, int]] = {}     # quoted at the begin, number of the next record, place, file
    number, quoted, before, files, first_record, pieced = 0, False, None, -1, None, False
    for place, (file, start, out, begun, head) in enumerate(_surveyed(lines)):
        if file != before:                                             # each file starts between records, its header isn't counted
            quoted, before, files = False, file, files + 1
            number -= bool(header and begun[0])
            first_record = head if not files else first_record
        splits[file, start] = quoted, number, place, files
        number += begun[quoted]
        quoted = out[quoted]
        pieced = pieced or quoted
    known = spark.sparkContext.broadcast(splits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        at, quoted, number, place, file, held, cut, first, top = None, False, 0, 0, 0, [], False, False, False

        def put(whole: bool) -> None:
            if held:
                text = "\n".join(held)
                rows.append({"file": file, "number": number, "place": -1 if whole else place, "record": text, "top": first})
                held.clear()
        for split, lines, opened, blank in _by_split(batches):
            if split != at:
                put(not quoted and not cut)
                if split not in known.value:
                    raise RuntimeError("the file's splits changed between two reads")
                at = split
                quoted, number, place, file = known.value[split]
                # the lines before the first record belong to the one before
                cut, number = quoted, number - 1
                first = False
                top = split[1] == 0 and not quoted
            i = 0
            while i < len(lines):
                if not quoted:
                    put(not cut)
                    cut = False
                    # whole records up to the next line that isn't closed
                    k = np.searchsorted(opened, i)
                    j = int(opened[k]) if k < len(opened) else len(lines)
                    full = np.flatnonzero(~blank[i:j])
                    if len(full):
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows.clear()
                        tops = np.zeros(len(full), bool)
                        tops[0], top = top, False
                        yield pa.record_batch([pa.array(np.full(len(full), file)), pa.array(number + 1 + np.arange(len(full))), pa.array(np.full(len(full), -1)),
                                               lines.slice(i, j - i).take(pa.array(full)), pa.array(tops)], schema=schema)
                        number += len(full)
                    if j == len(lines):
                        break
                    i = j
                    number += 1
                    first, top = top, False
                line = lines[i].as_py()
                held.append(line)
                quoted = quoted_after(line, quoted)
                i += 1
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows.clear()
        put(not quoted and not cut)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    schema = pa.schema([("file", pa.int64()), ("number", pa.int64()), ("place", pa.int64()), ("record", pa.string()), ("top", pa.bool_())])
    cuts = lines.mapInArrow(run, "file long, number long, place long, record string, top boolean")
    every = cuts.where("place < 0").select("file", "number", "record", "top")
    if pieced:                                                         # else every record is whole in its split
        pieces = (cuts.where("place >= 0").groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("place", "record", "top"))).alias("p"))
                  .select("file", "number", F.array_join(F.col("p.record"), "\n").alias("record"), F.get("p.top", F.lit(0)).alias("top")))
        every = every.unionAll(pieces)
    every = every.withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    if not header:
        return every.select("number", "record"), None
    if first_record is not None:
        return every.where("NOT top").select("number", "record"), first_record.removesuffix("\r")
    top = every.where("top AND file = 0").first()
    return every.where("NOT top").select("number", "record"), top["record"] if top else None


def header_names(record: str) -> list[str]:
    """Column names of a header, as Spark makes them: empty names are numbered, repeated ones too."""
    names = next(csv.reader([record])) if "\n" not in record else next(csv.reader(record.splitlines(keepends=True)))
    seen = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if seen.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, row_id: str | None = None, corrupt_column: str | None = None) -> DataFrame:
    """All columns of a CSV input as STRING, records with line breaks in quotes included, read by as many tasks as it has
    splits. ``row_id`` names a further column with each record's number; ``corrupt_column`` one with the text of
    records that have too few or too many fields."""
    records, top = csv_records(spark, path)
    names = header_names(top) if top is not None else []
    taken = [n for n in (row_id, corrupt_column) if n and n.lower() in {c.lower() for c in names}]
    if taken:
        raise ValueError(f"the input has a column {taken[0]}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([corrupt_column] if corrupt_column else [])]])
    if not names:
        return spark.createDataFrame([], schema)
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", **({"columnNameOfCorruptRecord": corrupt_column} if corrupt_column else {})}
    parsed = records.select("number", F.from_csv("record", _ddl(schema), options).alias("r"))
    extra = [F.col("number").alias(row_id)] if row_id else []
    return parsed.select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields], *extra)


def _ddl(schema: T.StructType) -> str:
    return ", ".join("`" + f.name.replace("`", "``") + "` string" for f in schema.fields)
