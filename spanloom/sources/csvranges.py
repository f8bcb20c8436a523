"""CSV rows with their place in the file, read by as many tasks as the file has ranges.

A file is scanned as text, so Spark cuts it into byte ranges that start at a line. A
line break may stand inside quotes, and whether a range starts inside quotes depends on
all that is before it. So each range is first walked under both assumptions at once:
for each one it says how many records end in it and whether it ends inside quotes. The
ranges of a file in order then settle which assumption holds, the number of the first
record of each range, and what the next ranges add to a record that one leaves open.
A second scan parses the records of each range alone, with their exact numbers.

A folder with the name of a file counts as that file, its parts following each other by
name. Numbers and values are those of Python's ``csv.DictReader``: blank lines are no
records, a record longer than ``csv.field_size_limit`` in one field is an error. The
header is the first record of a file; missing cells are empty.
"""

from __future__ import annotations

import csv
import io
from collections import defaultdict
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.session import write_and_read

#: Rows that are handed on at once.
CHUNK_ROWS = 10_000
PART = r"/part-[^/]+$"

RANGE = ("file string, path string, start long, n_free long, n_quoted long, open_free boolean, "
         "open_quoted boolean, first string, head string")


def _in_one_range(spark: SparkSession) -> Column:
    """Whether a scan never cuts a file: it is small, and not a part of one."""
    conf = spark._jsparkSession.sessionState().conf()
    uncut = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())
    return (F.col("_metadata.file_size") <= uncut) & ~F.col("_metadata.file_path").rlike(PART)


def text_lines(spark: SparkSession, folder: str, pattern: str, which: Column) -> DataFrame:
    """(file, path, start, line): lines of the files whose name fits, by the range they are in."""
    path = F.col("_metadata.file_path")
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(folder)
    return lines.where(which).select(F.regexp_replace(path, PART, "").alias("file"), path.alias("path"),
                        F.col("_metadata.file_block_start").alias("start"),
                        F.make_valid_utf8("value").alias("line")).where(F.col("file").rlike(pattern))


def closes(line: str, quoted: bool) -> bool:
    """Whether a record ends with ``line``, which starts inside quotes or at a record's start."""
    at, n = 0, len(line)
    while True:
        if not quoted:
            if not line.startswith('"', at):               # a plain field: quotes in it are text
                at = line.find(",", at) + 1
                if not at:
                    return True
                continue
            at += 1
        while True:                                        # inside quotes
            end = line.find('"', at)
            if end < 0:
                return False
            at = end + 1
            if line.startswith('"', at):
                at += 1
                continue
            break
        quoted = False
        at = line.find(",", at) + 1                        # text after the closing quote is kept
        if not at or at > n:
            return True


def _physical(line: str) -> Iterator[str]:
    """A line of the scan as the lines that ``csv`` sees: a lone carriage return ends one."""
    return iter(io.StringIO(line + "\n", newline=""))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The lines of each range of a partition; lines of a range follow each other."""
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))
    ahead = rows()
    row = next(ahead, None)
    while row is not None:
        key = row[:3]

        def lines():
            nonlocal row
            while row is not None and row[:3] == key:
                yield from _physical(row[3])
                row = next(ahead, None)
        own = lines()
        yield key, own
        for _ in own:                                      # what the caller left unread
            pass


class _Walk:
    """Records that end in a range, for one assumption about its start."""

    def __init__(self, quoted: bool):
        self.open, self.n, self.size = quoted, 0, 0
        self.text: list[str] | None = []                   # up to the first end of a record

    def take(self, line: str) -> None:
        if not self.open and not line.strip("\r\n"):
            return
        if self.text is not None and not self.n:
            self.size += len(line)
            # more than a record may hold: the assumption is wrong, or the file is
            self.text = self.text + [line] if self.size <= 4 * csv.field_size_limit() else None
        self.open = not closes(line.rstrip("\r\n"), self.open)
        self.n += not self.open

    def head(self) -> str | None:
        """The text up to the first end of a record, None if it is too long for one."""
        return None if self.text is None else "".join(self.text)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, lines in _ranges(batches):
        free, quoted = _Walk(False), _Walk(True)
        for line in lines:
            free.take(line)
            quoted.take(line)
        row = [*key, free.n, quoted.n, free.open, quoted.open, free.head(), quoted.head()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x], pa.string() if isinstance(x, str) or x is None else None) for x in row],
            ["file", "path", "start", "n_free", "n_quoted", "open_free", "open_quoted", "first", "head"])


@dataclass
class Place:
    """What the ranges before and after tell about one range."""
    quoted: bool                    # it starts inside quotes
    number: int                     # of the first record that ends in it; the header is -1
    rest: str = ""                  # what ends the record that it leaves open
    header: tuple[str, ...] = ()


def settled(ranges: DataFrame) -> dict[tuple[str, int], Place]:
    """The place of each range, by (path, start)."""
    files = defaultdict(list)
    for r in ranges.drop("first", "head").collect():
        files[r["file"]].append(r)
    out, firsts = {}, []
    for own in files.values():
        own.sort(key=lambda r: (r["path"], r["start"]))
        quoted, n, first = False, -1, None
        for r in own:
            out[r["path"], r["start"]] = Place(quoted, n)
            if first is None and (r["n_free"] or r["open_free"]):
                first = r["path"], r["start"]
            # a record that was open before ends here as the first one
            n += r["n_quoted"] if quoted else r["n_free"]
            quoted = r["open_quoted"] if quoted else r["open_free"]
        firsts.append(first)
    wanted = [(*k, out[k].quoted) for k in out if out[k].quoted or k in firsts]
    keys = ranges.sparkSession.createDataFrame(wanted, "path string, start long, quoted boolean")
    texts = {(r["path"], r["start"]): r["text"] for r in ranges.join(keys, ["path", "start"]).select(
        "path", "start", F.when(F.col("quoted"), F.col("head")).otherwise(F.col("first")).alias("text")).collect()}
    too_long = csv.Error(f"a record is longer than {4 * csv.field_size_limit()} characters")
    if None in texts.values():
        raise too_long
    for own, first in zip(files.values(), firsts):
        rest = ""
        for r in reversed(own):
            key = r["path"], r["start"]
            out[key].rest = rest
            ends = r["n_quoted"] > 0
            rest = (texts[key] if ends else texts[key] + rest) if out[key].quoted else ""
            if len(rest) > 4 * csv.field_size_limit():
                raise too_long
        if first is not None:
            text = texts[first] + out[first].rest
            header = tuple(next(csv.reader(io.StringIO(text, newline="")), ()))
            for r in own:
                out[r["path"], r["start"]].header = header
    return out


def _parsed(places, columns: list[str]):
    def records(lines: Iterator[str], place: Place) -> Iterator[list[str]]:
        def own() -> Iterator[str]:
            inside = place.quoted
            while inside:                                  # the range before has this record
                line = next(lines, None)
                if line is None:
                    return
                inside = not closes(line.rstrip("\r\n"), True)
            yield from lines
            yield from io.StringIO(place.rest, newline="")
        return (r for r in csv.reader(own()) if r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, path, start), lines in _ranges(batches):
            place = Place(False, -1) if places is None else places.value[path, start]
            found = records(lines, place)
            header = next(found, ()) if places is None else place.header
            at = {name: i for i, name in enumerate(header)}
            own = [at.get(c, -1) for c in columns]
            # the record that ends here is not ours, and the header has been read
            first = place.number + (place.quoted or places is None)
            part: list[list] = []

            def batch():
                return pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for x in part], t) for i, t in enumerate(
                        [pa.string(), pa.int64(), *[pa.string()] * len(columns)])],
                    ["path", "row", *[f"c{i}" for i in range(len(columns))]])
            for i, r in enumerate(found, first):
                if i >= 0:
                    part.append([file, i] + [r[k] if 0 <= k < len(r) else "" for k in own])
                if len(part) == CHUNK_ROWS:
                    yield batch()
                    part = []
            if part:
                yield batch()
    return run


def rows(spark: SparkSession, folder: str, pattern: str, columns: dict[str, str]) -> DataFrame:
    """(path, row, *names) of the CSV files below ``folder`` whose path fits ``pattern``.

    ``columns`` maps header cells to names; ``row`` counts from 0 in each file. Files that
    a scan never cuts are parsed in one scan; nothing of them comes to the driver. Of each
    range of the others, 128 MB by default, a few numbers come to the driver, and the text up to the
    first end of a record where one is open at its start.
    """
    small = _in_one_range(spark)
    schema = ", ".join(["path string, row long", *[f"c{i} string" for i in range(len(columns))]])
    whole = text_lines(spark, folder, pattern, small).mapInArrow(_parsed(None, list(columns)), schema)
    lines = text_lines(spark, folder, pattern, ~small)
    found = write_and_read(lines.mapInArrow(_summaries, RANGE), "csv_ranges")
    places = spark.sparkContext.broadcast(settled(found))
    parsed = whole.unionByName(lines.mapInArrow(_parsed(places, list(columns)), schema))
    return parsed.select("path", F.col("row").cast("int"),
                         *[F.col(f"c{i}").alias(n) for i, n in enumerate(columns.values())])
