import os
import random
import subprocess
import sys
import uuid

import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import simhash
from spanloom.llm.components import components
from spanloom.llm.digests import DigestIndex
from spanloom.session import forget, shared_dir

WORDS = "the an of in road tree Éa ñu river stone light night walk talk".split()


def slow_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def texts(rnd, n=160):
    made = []
    for _ in range(n):
        if made and rnd.random() < 0.6:
            words = rnd.choice(made).split(" ")
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
            made.append(" ".join(words))
        else:
            made.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([1, 3, 40, 300]))))
    return made


def test_fingerprints_and_classes(spark):
    rnd = random.Random(1)
    rows = list(enumerate(texts(rnd) + ["", None, " \t", "A  b\nC", "a b c"]))
    rows.append((3, rows[3][1]))                                # a repeated row
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows],
                                 "doc_id long, text string, fp long, node string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {i: slow_print(t) for i, t in rows}
    wanted = classes([(a, b) for a in prints for b in prints
                      if a < b and (prints[a] ^ prints[b]).bit_count() <= 4], prints)
    assert {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in found} == {
        i: (prints[i], wanted[i]) for i in prints}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in prints if wanted[i] == i}


@pytest.mark.parametrize("distance, segments, crowded", [
    (4, 3, 1), (4, 3, 1024), (4, 2, 3), (4, 4, 1024), (3, 3, 1), (5, 3, 2), (1, 3, 1024)])
def test_links_join_all_close_fingerprints(spark, distance, segments, crowded):
    rnd = random.Random(distance * segments)
    values = {rnd.getrandbits(64) for _ in range(20)}
    for v in list(values):
        for _ in range(4):
            for _ in range(rnd.randrange(1, 6)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    nodes = {v: i for i, v in enumerate(sorted(values))}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for v, i in nodes.items()],
                                  "fp long, node long")
    found = components(simhash.links(frame, distance, segments, crowded)).collect()
    wanted = classes([(nodes[a], nodes[b]) for a in values for b in values
                      if a < b and (a ^ b).bit_count() <= distance], nodes.values())
    linked = {n: c for n, c in wanted.items() if list(wanted.values()).count(c) > 1}
    assert {r.node: r.component for r in found} == linked


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7), (9, 8)]
    found = {r.node: r.component for r in
             components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    wanted = classes(pairs, {x for p in pairs for x in p})
    assert found == wanted
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (None, "x")],
                                 "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert found == {(None, 5), (None, None), (5, 5)}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_digest_index_over_batches(spark):
    index = DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}", buckets=4)
    first = spark.createDataFrame([(1, "a"), (4, "a"), (4, "a"), (2, None), (3, ""), (None, "z")],
                                  "doc_id long, text string")
    found = index.ingest(first).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("h")).collect()
    assert sorted([(r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in found], key=str) == sorted(
        [(1, 4, 3, False), (4, 4, 3, True), (4, 4, 3, False), (2, 3, 2, False), (3, 3, 2, True),
         (0, None, 1, True)], key=str)
    assert {r.h for r in found if r.doc_id == 3} == {
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}
    later = spark.createDataFrame([(9, "a"), (8, "new"), (7, "new")], "doc_id long, text string")
    found = index.ingest(later).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in found) == [
        (7, 8, False), (8, 8, True), (9, 4, False)]
    assert index.table().count() == 4
    assert index.ingest(later.limit(0)).count() == 0 and index.table().count() == 4
    some = index.table().select(F.concat("digest", F.lit("x").cast("binary")).alias("digest"))
    plan = some.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


OTHER_PROCESS = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
from spanloom.llm.digests import DigestIndex
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", sys.argv[2] + "-work").config("spark.sql.shuffle.partitions", "3").getOrCreate())
index = DigestIndex(spark, sys.argv[2])
assert index.buckets == 5 and index.table().count() == 40, (index.buckets, index.table().count())
docs = spark.createDataFrame([(100 + i, f"text {i}") for i in range(35, 45)], "doc_id long, text string")
assert sorted(r.keep_id for r in index.ingest(docs, "b").collect()) == [35, 36, 37, 38, 39, 140, 141, 142, 143, 144]
"""


def test_digest_index_in_another_process(spark, tmp_path):
    path = f"{tmp_path}/index"
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    DigestIndex(spark, path, buckets=5).ingest(docs, "a")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", OTHER_PROCESS, root, path], check=True, timeout=300)
    again = DigestIndex(spark, path)
    assert again.table().count() == 45 and sorted(again.commits()) == ["a", "b"]
    forget(spark, f"{path}/data")
    assert DigestIndex(spark, path, buckets=9).table().count() == 45


def test_digest_batches_are_repeated_without_change(spark, tmp_path, monkeypatch):
    index = DigestIndex(spark, str(tmp_path), buckets=3)
    first = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(8, "b"), (9, "c")], "doc_id long, text string")

    def answer(rows):
        return sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows.collect())
    a, b = answer(index.ingest(first, "a")), answer(index.ingest(later, "b"))
    assert b == [(8, 3, 1, False), (9, 9, 1, True)]
    assert answer(index.ingest(first, "a")) == a and answer(index.ingest(later, "b")) == b
    assert index.table().count() == 3
    # an attempt that fails before its commit leaves files that nothing reads
    third = spark.createDataFrame([(11, "d")], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(spark, "createDataFrame", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.ingest(third, "c")
    assert index.table().count() == 3
    assert answer(index.ingest(third, "c")) == [(11, 11, 1, True)] and index.table().count() == 4


def test_digest_join_does_not_move_the_index(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path), buckets=3)
    index.ingest(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "a")
    new = spark.createDataFrame([(bytes(32),)], "digest binary")
    plan = new.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_digest_of_long_texts_and_carried_columns(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path), buckets=2)
    docs = spark.createDataFrame([(1, "é" * 3_000_000, "x", 5), (2, "é" * 3_000_000, None, 6)],
                                 "doc_id long, text string, kept string, n int")
    found = index.ingest(docs, carry=("kept", "n")).collect()
    assert sorted((r.doc_id, r.n, r.kept, r.group_size) for r in found) == [(1, 5, False, 2), (2, 6, True, 2)]
