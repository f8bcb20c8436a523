"""Text index, snapshot trees and ordered files against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.text import contains_ci, like_ci
from spanloom.operators import snapshots
from spanloom.operators.sketches import TextSketches
from spanloom.operators.textindex import TextIndex, literals_of_like
from spanloom.sources import sinks

SCHEMA = "doc_id string, position int, unit_text string"


@pytest.fixture(scope="module")
def units(spark):
    rnd = random.Random(4)
    words = "the and Data privacy É é ÄA ab a policy 100% x_y zebra".split()
    rows = [(f"d{i % 40}", i // 40, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9)))) for i in range(600)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def index(units, tmp_path_factory):
    return TextIndex.build(units, str(tmp_path_factory.mktemp("index")))


@pytest.mark.parametrize("named", [100, 1])
def test_index_finds_what_a_scan_finds(units, index, monkeypatch, named):
    from spanloom.operators import textindex
    monkeypatch.setattr(textindex, "NAMED", named)
    for q in ("the and", "PRIVACY", "É", "é ä", "ÄA", "ab", "zebra the", "nowhere", "y zebra x", "a"):
        wanted = {tuple(r) for r in units.where(contains_ci(F.col("unit_text"), q)).collect()}
        found = index.narrowed(units, [q]).where(contains_ci(F.col("unit_text"), q)).select(*units.columns)
        assert {tuple(r) for r in found.collect()} == wanted, q
    for q in ("the%privacy", "x_y", "100%", "%", "_olicy the"):
        wanted = {tuple(r) for r in units.where(like_ci(F.col("unit_text"), q)).collect()}
        found = index.narrowed(units, literals_of_like(q)).where(like_ci(F.col("unit_text"), q)).select(*units.columns)
        assert {tuple(r) for r in found.collect()} == wanted, q


def test_rarest_trigrams_come_first(units, index):
    grams = index.rarest(["zebra the"])
    counts = {r.gram: r.n for r in index.grams.collect()}
    assert len(grams) == 4 and [counts[g] for g in grams] == sorted(counts[g] for g in grams)
    assert max(counts[g] for g in grams) <= sorted(counts[g] for g in {"zebra the"[i:i + 3] for i in range(7)})[3]
    assert index.rarest(["qqq"]) is None and index.rarest(["ab"]) == []
    plan = index.places(grams[:1])._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(gram,{grams[0]})" in plan
    held = index.postings.select("gram", F.explode("places").alias("p"), "doc_id")
    assert held.count() == sum(len({t[i:i + 3] for i in range(len(t) - 2)}) for t in [
        "".join(c.lower() if c.isascii() else c for c in r.unit_text) for r in units.collect()])


def test_postings_are_made_once(units, monkeypatch, tmp_path):
    plans, deal = [], type(units).repartitionByRange

    def noted(self, *keys):                               # bounds of ranges read their rows once more
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return deal(self, *keys)
    monkeypatch.setattr(type(units), "repartitionByRange", noted)
    TextIndex.build(units, str(tmp_path / "once"))
    assert not any(x in plans[0] for x in ("Generate", "MapInArrow", "ObjectHashAggregate"))


def test_postings_are_lists_by_block(units, tmp_path, monkeypatch):
    from spanloom.operators import textindex
    index = TextIndex.build(units.coalesce(1), str(tmp_path / "one"))
    assert index.blocks.count() == 1 and index.lists.count() == index.grams.count() > 50
    twice = TextIndex.build(units.unionByName(units).coalesce(2), str(tmp_path / "twice"))
    assert twice.blocks.count() == 2 and twice.rarest(["zebra the"]) == index.rarest(["zebra the"])
    assert sorted((r.doc_id, sorted(r.places)) for r in twice.places(["dat"]).collect()) == sorted(
        (r.doc_id, sorted(r.places)) for r in index.places(["dat"]).collect())


def test_lists_hold_the_texts_of_each_trigram():
    from spanloom.operators.textindex import _grams_of
    many = [chr(c) * 2 + "É" for c in range(0x3400, 0xD000)]       # so many letters and texts that trigrams are ranked
    for texts in ([], ["", "ab"], ["abcABC", "", "xabé", "😀é😀x"], many + [""] * 400_000):
        wanted = {}
        for i, t in enumerate(texts):
            low = "".join(c.lower() if c.isascii() else c for c in t)
            for gram in {low[j:j + 3] for j in range(len(low) - 2)}:
                wanted.setdefault(gram, []).append(i)
        grams, ends, numbers = _grams_of(texts)
        assert {g: numbers[a:b].tolist() for g, a, b in zip(grams, ends, ends[1:])} == wanted


def test_changes_of_versions(spark, units, tmp_path):
    old = snapshots.Tree.build(units, str(tmp_path / "old"))
    same = snapshots.Tree.build(units.repartition(7), str(tmp_path / "same"))
    assert snapshots.differing_buckets(old, same) == [] and snapshots.changes(old, same).count() == 0
    late = units.where("doc_id <> 'd3'").withColumn("unit_text", F.when(
        F.expr("doc_id = 'd5' AND position = 0"), None).otherwise(F.col("unit_text"))).unionByName(
        spark.createDataFrame([("new", 0, None), ("d7", 99, "")], SCHEMA))
    new = snapshots.Tree.build(late, str(tmp_path / "new"))
    found = {(r.doc_id, r.change) for r in snapshots.changes(old, new).collect()}
    assert found == {("d3", "removed"), ("d5", "changed"), ("new", "added"), ("d7", "changed")}
    assert len(snapshots.differing_buckets(old, new)) <= 4
    plan = snapshots.changes(old, new)._jdf.queryExecution().executedPlan().toString()
    assert "In(bucket, [" in plan or "EqualTo(bucket," in plan        # equal buckets are not read


def test_nulls_are_values_of_a_digest(spark, tmp_path):
    a = snapshots.Tree.build(spark.createDataFrame([("d", None, "x")], "doc_id string, a string, b string"), str(tmp_path / "a"))
    b = snapshots.Tree.build(spark.createDataFrame([("d", "x", None)], "doc_id string, a string, b string"), str(tmp_path / "b"))
    assert [tuple(r) for r in snapshots.changes(a, b).collect()] == [("d", "changed")]
    none = snapshots.Tree.build(spark.createDataFrame([], "doc_id string, a string, b string"), str(tmp_path / "none"))
    assert [r.change for r in snapshots.changes(none, b).collect()] == ["added"]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_files_in_order(spark, tmp_path, fmt):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # several files of few rows
    rows = [(f"d{i % 23:02d}", i, f"text {i}, \"quoted\"", "train" if i % 23 % 3 else "test") for i in range(900)]
    frame = spark.createDataFrame(rows, "_doc string, _place int, text string, part string").repartition(6)
    sinks.write_splits(frame, str(tmp_path / "data"), fmt, "_doc", ("_place",))
    found, files = {"train": [], "test": []}, {}
    for part in found:
        for file in sorted((tmp_path / "data" / f"part={part}").glob("part-*")):
            own = (spark.read.option("header", True).option("escape", '"').csv(str(file)) if fmt == "csv"
                   else spark.read.format(fmt).load(str(file))).collect()
            found[part] += [r.text for r in own]
            files[part, file.name] = len(own)
    for part, texts in found.items():
        assert texts == [t for d, p, t, s in sorted(rows) if s == part]
    assert {(r.part, r.file): r.n for r in sinks.parts(spark, str(tmp_path / "data"), frame.drop("_doc", "_place").schema, fmt).collect()} == files
    assert len(files) > 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_sketches_merge_and_differ(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice(["en", "de", None]), "sentence", rnd.choice(["single_label", "unlabeled"]),
             None if i % 97 == 0 else f"text {rnd.randrange(20_000)}") for i in range(30_000)]
    frame = spark.createDataFrame(rows, "subset string, unit_kind string, label_category string, unit_text string")
    for lg, error in ((16, 0), (10, 0.12)):
        parts = [TextSketches.build(frame.where(c), str(tmp_path / f"{lg}-{i}"), lg) for i, c in enumerate(
            ("subset = 'en'", "subset = 'de'", "subset IS NULL"))]
        all_ = parts[0].merged(parts[1]).merged(parts[2])
        texts = {c: {t for _, _, x, t in rows if x == c and t} for c in ("single_label", "unlabeled")}
        whole = all_.counts().first()
        assert whole.units == len(rows) and whole.unique_fragments == 0
        union = len(texts["single_label"] | texts["unlabeled"])
        assert abs(whole.unique_sentences - union) <= error * union
        assert abs(whole.never_unlabeled - len(texts["single_label"] - texts["unlabeled"])) <= error * union
        assert {r.subset for r in all_.counts("subset").collect()} == {"en", "de", None}
    empty = TextSketches.build(frame.limit(0), str(tmp_path / "none"))
    assert empty.counts("subset").count() == 0


def test_counts_beyond_the_sketches_are_exact(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["sentence", "fragment"]),
             rnd.choice(["single_label", "unlabeled", "unlabeled"]),
             None if i % 97 == 0 else f"text {rnd.randrange(3_000)}") for i in range(6_000)]
    frame = spark.createDataFrame(rows, "subset string, unit_kind string, label_category string, unit_text string")
    sketches = TextSketches.build(frame, str(tmp_path / "cells"), 10)      # en has far more than 2^10

    def model(s):
        own = [r for r in rows if r[0] == s]
        texts = {x: {r[3] for r in own if x in r and r[3]} for x in ("sentence", "fragment", "single_label", "unlabeled")}
        return (s, len(own), len(texts["sentence"]), len(texts["fragment"]), len(texts["single_label"]),
                len(texts["single_label"] - texts["unlabeled"]))
    wanted = {model(s) for s in ("en", "de", None)}
    assert {tuple(r) for r in sketches.counts("subset", units=frame).collect()} == wanted
    assert {tuple(r) for r in sketches.counts("subset").collect()} != wanted
    assert sketches.counts(units=frame).first().units == len(rows)
