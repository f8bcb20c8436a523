"""Cap and splits against plain loops."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import dataset as D

NAMES = list("ABCDE")


def random_rows(seed, docs=12, most=3, size=20):
    r = random.Random(seed)
    return [(f"d{d}", p, r.sample(NAMES, r.randint(0, most)))
            for d in range(docs) for p in range(1, r.randint(1, size) + 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, position int, labels array<string>")


def cap_model(rows, pct):
    kept, by_doc = [], {}
    for row in rows:
        by_doc.setdefault(row[0], []).append(row)
    for doc, items in by_doc.items():
        allowed, used = max(1, math.ceil(len(items) * pct / 100.0)), {}
        for row in items:
            names = row[2] or ["UNLABELED"]
            if all(used.get(n, 0) < allowed for n in names):
                kept.append((doc, row[1]))
                for n in names:
                    used[n] = used.get(n, 0) + 1
    return set(kept)


@pytest.mark.parametrize("most,repeated,bucket", [(1, False, 3), (3, False, 100), (3, True, 5)])
def test_cap(spark, most, repeated, bucket):
    rows = random_rows(most + bucket, most=most, docs=8)
    if repeated:
        rows = [(d, p, names + names[:1]) for d, p, names in rows]
    capped = D.cap_labels(frame(spark, rows), 20, ["position"],
                          bucket=F.floor(F.col("position") / bucket))
    got = [(r.doc_id, r.position) for r in capped.select("doc_id", "position").collect()]
    assert len(got) == len(set(got)) and set(got) == cap_model(rows, 20)


@pytest.mark.parametrize("seed, pct, width", [(1, 5, 7), (2, 30, 20), (3, 1, 50), (4, 60, 3)])
def test_cap_of_large_documents_walks_buckets(spark, seed, pct, width):
    rnd = random.Random(seed)
    rows = [("big", i, [rnd.choice("abcdefg") for _ in range(rnd.randrange(0, 4))]) for i in range(300)]
    rows += [(f"d{i % 5}", i, [rnd.choice("ab"), rnd.choice("abc")]) for i in range(40)]
    got = D.cap_labels(frame(spark, rows), pct, ["position"], bucket=F.floor(F.col("position") / width))
    assert {(r.doc_id, r.position) for r in got.collect()} == cap_model(rows, pct)


def test_cap_rounds_are_at_most_the_buckets(spark):
    # every row waits for the one before: a, then a b, then b c, … with a limit of one
    rows = [("big", i, [f"l{i}", f"l{i + 1}"]) for i in range(60)]
    for width, most in ((60, 1), (10, 6), (100, 1)):
        keyed = spark.createDataFrame([(d, i, n, 1, i // width, i, None) for d, i, n in rows],
                                      "_doc string, _id long, _names array<string>, _limit long, _bucket long, "
                                      "_o0 long, _kept boolean")
        kept, rounds = D.jointly_kept(keyed)
        assert {r[0] for r in kept.collect()} == set(range(0, 60, 2)) and rounds <= most


def test_cap_counts_occurrences(spark):
    rows = [("d", i, ls) for i, ls in enumerate([["A", "A"], ["A", "A"], ["A", "A"], ["A", "B"], ["B", "C"]])]
    assert {r.position for r in D.cap_labels(frame(spark, rows), 60, ["position"]).collect()} == {0, 1, 4}


def test_cap_golden(spark):
    rows = [("d", 1, ["a"]), ("d", 2, ["a", "b"]), ("d", 3, ["b"])]
    got = D.cap_labels(frame(spark, rows), 1, ["position"]).collect()
    assert {r.position for r in got} == {1, 3}
    assert D.cap_labels(frame(spark, rows), 0, ["position"]).count() == 3


def half_even(total, pct):
    return round(total * pct / 100)


def split_model(docs, ratios, seed):
    """docs: {doc: n} of one bin."""
    train, ev, te = ratios
    order = sorted(docs, key=lambda d: (hashlib.md5(f"{seed}:{d}".encode()).hexdigest(), d))
    total, in_train, in_eval, out = sum(docs.values()), 0, 0, {}
    for d in order:
        if in_train < half_even(total, train) or (not ev and not te):
            out[d], in_train = "train", in_train + docs[d]
        elif ev and in_eval < half_even(total, ev):
            out[d], in_eval = "eval", in_eval + docs[d]
        else:
            out[d] = "test" if te else "train"
    active = ["train"] + ["eval"] * bool(ev) + ["test"] * bool(te)
    missing = [s for s in active if s not in out.values()]
    if missing and len(order) >= len(active):
        for s in missing:
            counts = {}
            for d in order:
                counts[out[d]] = counts.get(out[d], 0) + 1
            donor = max(counts, key=counts.get)
            if counts[donor] > 1:
                out[next(d for d in order if out[d] == donor)] = s
    return out


@pytest.mark.parametrize("ratios", [(70, 15, 15), (0, 50, 50), (100, 0, 0), (80, 20, 0), (34, 33, 33), (0, 0, 100)])
def test_fill_splits(spark, ratios):
    r = random.Random(sum(ratios[:2]))
    bins = {f"b{i}": {f"b{i}_{j}": r.choice([1, 2, 9]) for j in range(r.choice([1, 2, 3, 4, 5, 30]))} for i in range(25)}
    rows = [(d, b, n) for b, ds in bins.items() for d, n in ds.items()]
    got = D.fill_splits(spark.createDataFrame(rows, "doc_id string, bin string, n long"), *ratios, 42)
    want = {}
    for ds in bins.values():
        want.update(split_model(ds, ratios, 42))
    assert {r.doc_id: r.split for r in got.collect()} == want


def test_stratified_bins_and_leaks(spark):
    rows = random_rows(5, docs=40)
    df = frame(spark, rows)
    docs = {r.doc_id: r.bin for r in D.document_bins(D.document_labels(df)).collect()}
    labels = {}
    for d, _, ls in rows:
        labels.setdefault(d, set()).update(ls)
    count = {n: sum(n in s for s in labels.values()) for n in NAMES}
    assert docs == {d: min(s, key=lambda n: (count[n], n)) if s else "__unlabeled__" for d, s in labels.items()}
    for stratify in (True, False):
        split = D.split_rows(df, 70, 15, 15, 42, stratify)
        assert split.count() == len(rows)
        assert split.groupBy("doc_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_ratios_and_rows(spark):
    df = frame(spark, [("d", i, []) for i in range(1, 11)])
    with pytest.raises(ValueError):
        D.split_rows(df, 80, 15, 15)
    by_row = D.split_by_row(df, 70, 15, 15, 1, "position").groupBy("split").count().collect()
    assert {tuple(r) for r in by_row} == {("train", 7), ("eval", 2), ("test", 1)}


def test_tokens(spark):
    df = spark.createDataFrame([("A / B-c",), ("Others",), ("Description of Right to Know PI sold / shared",)], "l string")
    assert [r[0] for r in df.select(D.label_token(F.col("l"))).collect()] == [
        "A__OR__B_C", "OTHERS", "DESCRIPTION_OF_RIGHT_TO_KNOW_PI_SOLD_OR_SHARED"]
