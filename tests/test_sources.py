"""CSV records numbered over byte ranges, against the csv module over whole files."""

import csv
import io
import os
import random

import pytest

from spanloom.sources import csvranges, files

COLUMNS = {"A": "a", "B": "b", "C": "c"}


def slow_rows(text):
    reader = csv.DictReader(io.StringIO(text, newline=""))
    return [(i, *[row.get(c) or "" for c in COLUMNS]) for i, row in enumerate(reader)]


def sample(rnd, n):
    """Records with quoted breaks, doubled and stray quotes, blank lines and short rows."""
    cells = ["x", "", "plain", 'a "stray" one', '"q"', '"a\nb"', '"a\r\nb\n\n"', '"say ""hi"", now"', '"x"tail',
             '"x"t"a"il', '"', "é ñ", "x" * 40] if rnd.random() < 0.5 else ["x", "", '"a\nb"', '"c, d"', "é"]
    cells = [c for c in cells if c != '"']
    out = ["A,B,C", "C,A,B,D", '"A","B\nB",C'][rnd.randrange(3)] + "\n"
    for _ in range(n):
        out += ",".join(rnd.choice(cells) for _ in range(rnd.randrange(1, 5))) + rnd.choice(["\n", "\r\n", "\n\n", "\r"])
    return out


@pytest.fixture
def small_ranges(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "160")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_numbers_over_ranges(spark, small_ranges, tmp_path):
    rnd = random.Random(7)
    wanted = {}
    for k in range(8):
        text = sample(rnd, rnd.choice([0, 1, 40, 60]))
        path = tmp_path / f"{k}.csv"
        path.write_bytes(text.encode())
        wanted[path.name] = slow_rows(text)
    (tmp_path / "note.txt").write_text("A,B,C\n1,2,3\n")
    (tmp_path / "empty.csv").write_text("")
    found = csvranges.rows(spark, str(tmp_path), r"\.csv$", COLUMNS)
    assert found.rdd.getNumPartitions() > 20
    got = {name: [] for name in wanted}
    for r in found.collect():
        got[r.path.rpartition("/")[2]].append(tuple(r)[1:])
    assert {n: sorted(v) for n, v in got.items()} == wanted


def test_ranges_inside_one_quoted_cell(spark, small_ranges, tmp_path):
    text = 'A,B,C\n1,"' + "\n".join(f"line {i}, not a record" for i in range(60)) + '",z\n2,3,4\n'
    (tmp_path / "x.csv").write_text(text)
    found = csvranges.rows(spark, str(tmp_path), r"\.csv$", COLUMNS).collect()
    assert sorted(tuple(r)[1:] for r in found) == slow_rows(text)


def test_parts_of_a_folder_are_one_file(spark, small_ranges, tmp_path):
    os.makedirs(tmp_path / "db.csv")
    rnd = random.Random(3)
    lines = ["A,B,C\n"] + [f'{i},"x\n{rnd.random()}",é\n' for i in range(90)]
    for k in range(5):
        (tmp_path / "db.csv" / f"part-{k:05d}-x.txt").write_text("".join(lines[k * 20:k * 20 + 20]))
    found = sorted(tuple(r)[1:] for r in csvranges.rows(spark, str(tmp_path), r"\.csv$", COLUMNS).collect())
    assert found == slow_rows("".join(lines))


def test_a_quote_that_never_ends(spark, small_ranges, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    (tmp_path / "x.csv").write_text('A,B,C\n1,"' + "no end\n" * 90000)
    with pytest.raises(Exception, match="larger than field limit"):
        csvranges.rows(spark, str(tmp_path), r"\.csv$", COLUMNS).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    with pytest.raises(csv.Error, match="longer than"):
        csvranges.rows(spark, str(tmp_path), r"\.csv$", COLUMNS)


def test_crawl_numbers(spark, small_ranges, tmp_path):
    os.makedirs(tmp_path / "Crawl")
    text = "Link,IsHomepage\n" + "".join(f'" http://{i}\n",y\n' for i in range(40))
    (tmp_path / "Crawl" / "ws.csv").write_text(text)
    found = files.read_crawl(spark, str(tmp_path)).collect()
    assert sorted((r.num, r.link, r.subset) for r in found) == [(i + 1, f"http://{i}", "WS") for i in range(40)]


def test_small_files_send_nothing_to_the_driver(spark, tmp_path, monkeypatch):
    rnd = random.Random(9)
    wanted = {}
    for k in range(30):
        text = sample(rnd, rnd.choice([0, 1, 9]))
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
        wanted[f"{k}.csv"] = slow_rows(text)
    settled = csvranges.settled

    def none(ranges):
        assert ranges.count() == 0
        return settled(ranges)
    monkeypatch.setattr(csvranges, "settled", none)
    got = {name: [] for name in wanted}
    for r in csvranges.rows(spark, str(tmp_path), r"\.csv$", COLUMNS).collect():
        got[r.path.rpartition("/")[2]].append(tuple(r)[1:])
    assert {n: sorted(v) for n, v in got.items()} == wanted
