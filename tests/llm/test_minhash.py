import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import minhash, simhash
from spanloom.llm.common import staged


def slow_sets(rows, k):
    sets = []
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets.append((i, {b" ".join(words[j:j + k]) for j in range(max(1, len(words) - k + 1))}
                     if words else set()))
    return sets


def slow_classes(rows, percent=80, k=5, link_empty=False):
    """Smallest reachable id of each (id, text) by brute force over all pairs."""
    sets = slow_sets(rows, k)
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if (x and y or link_empty) and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in up}


def sample(rnd):
    """Copies on both sides of 0.8, chains of copies, a shared passage, a group around one text."""
    rows = []
    for _ in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([8, 60, 100, 300]))]
        for _ in range(4):
            rows.append((len(rows), " ".join(words)))
            for _ in range(max(1, len(words) // rnd.choice([20, 40, 45, 50, 60, 100]))):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(3000)}"
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(len(rows) + i, f"{passage} {' '.join(f'q{rnd.randrange(50)}' for _ in range(40))}") for i in range(60)]
    long = [f"x{i}" for i in range(200)]
    for i in range(120):
        own = list(long)
        for _ in range(rnd.randrange(1, 8)):
            own[rnd.randrange(200)] = f"y{i}"
        rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows) + i, t) for i, t in enumerate(["", None, " \t", "A  b\nC", "a b c", "a b", "a", "A"])]


@pytest.mark.parametrize("k, percent", [(2, 80), (5, 80), (3, 60)])
def test_classes_equal_brute_force(spark, k, percent):
    rows = sample(random.Random(k))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    found = minhash.near_duplicates(docs, percent, k).collect()
    wanted, size = slow_classes(rows, percent, k), {i: len(s) for i, s in slow_sets(rows, k)}
    if percent >= 80:                       # below, the bands may miss a pair
        assert {r.doc_id: r.component_id for r in found} == wanted
    assert {r.doc_id: r.n_shingles for r in found} == size
    assert all(r.kept == (r.doc_id == r.component_id) for r in found) and len(found) == len(rows)


def test_near_copies_of_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(100))
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "z"), (3, "z"), (None, "q"), (7, long), (6, long + " y"),
            (9, ""), (10, None), (11, "w " * 200000), (12, "w " * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # no id counts as the largest one, and its rows are one document
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:3]) for r in kept.collect()) == [
        (3, "z"), (6, "x0 "), (9, ""), (10, ""), (11, "w w")]
    assert minhash.keep_first(docs.limit(0)).count() == 0
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    alone = minhash.near_duplicates(docs.where("text = 'q'")).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in alone] == [(None, None, True)]


def test_shared_passage_makes_few_candidates(spark, monkeypatch):
    rnd = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(24))
    rows = [(i, f"{passage} {' '.join(f'v{rnd.randrange(90000)}' for _ in range(60))}") for i in range(2000)]
    compared = []

    def counted(pairs, *more):
        compared.append(pairs.count())
        return likely(pairs, *more)
    likely = minhash.likely
    monkeypatch.setattr(minhash, "likely", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash.near_copies(docs).where("id <> first").count() == 0
    assert sum(compared) < 10 * len(rows)


def test_group_of_near_copies_is_not_compared_in_pairs(spark, monkeypatch):
    rnd = random.Random(2)
    base = [f"x{i}" for i in range(150)]
    rows = []
    for i in range(1500):
        own = list(base)
        own[rnd.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(own)))
    compared = []

    def counted(pairs, *more):
        compared.append(pairs.count())
        return likely(pairs, *more)
    likely = minhash.likely
    monkeypatch.setattr(minhash, "likely", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.first for r in minhash.near_copies(docs).select("first").collect()} == {0}
    assert sum(compared) < 40 * len(rows)                   # a hub in each band


def test_posterior_bounds_and_signatures():
    assert minhash.least_matches(64, 80, 1e-9) < minhash.least_matches(64, 80, 1e-3) < 0.8 * 64
    assert minhash.least_matches(256, 80, 1e-9) > minhash.least_matches(64, 80, 1e-9)
    rng = np.random.default_rng(1)
    share = []
    for _ in range(60):
        grams = rng.integers(0, 1 << 63, 300, np.uint64)
        share.append((minhash.minima(grams[:200]) == minhash.minima(grams[100:])).mean())
    assert abs(np.mean(share) - 1 / 3) < 0.02               # 100 of 300 are common


def test_pruning_keeps_similar_pairs(spark):
    rows = sample(random.Random(4))
    docs = spark.createDataFrame(rows, "id long, text string")
    signed = staged(minhash.signatures(docs, 5), "signed")
    sigs = signed.where("node IS NOT NULL").dropDuplicates(["node"]).select("node", "sig")
    node = {r.id: r.node for r in signed.collect()}
    pairs = sigs.select(F.col("node").alias("a")).join(sigs.select(F.col("node").alias("b")), F.expr("a < b"))
    left = {(r.a, r.b) for r in minhash.likely(pairs, sigs, 80, 1e-9).collect()}
    sets = slow_sets(rows, 5)
    wanted = {tuple(sorted((node[a], node[b]))) for n, (a, x) in enumerate(sets) for b, y in sets[:n]
              if x and y and node[a] != node[b] and 100 * len(x & y) >= 80 * len(x | y)}
    assert wanted <= left and len(left) < 0.2 * pairs.count()


def test_pipeline_stage_equals_brute_force(spark):
    rows = sample(random.Random(5))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = corpus_pipeline.first_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, first in slow_classes(rows, link_empty=True).items() if i == first}


def test_pipeline_stage_links_by_fingerprints_first(spark, monkeypatch):
    words = [f"w{i}" for i in range(600)]
    far = [*words[:150], *map(str, range(450))]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(["start", *words[1:]])),
            (4, " ".join(far)), (5, None), (6, " ")]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    assert all((prints[0] ^ p).bit_count() <= 4 < (prints[0] ^ prints[3]).bit_count() for p in prints[1:3])
    compared = []

    def no_bands(own, signed, percent, words_in, miss, found=None):
        compared.append({tuple(r) for r in found.collect()})
        return found
    monkeypatch.setattr(minhash, "links", no_bands)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.first_of_near_copies(spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5}
    assert len(compared[0]) == 2


def test_pipeline_stage_compares_every_link_of_fingerprints(spark, monkeypatch):
    """Members that only resemble other members than the first of their class, and rows without an id."""
    rnd = random.Random(409)
    chain = [[f"w{rnd.randrange(10 ** 6)}" for _ in range(60)]]
    for k in range(3):
        chain.append([*chain[-1][:10 + k * 15], f"x409-{k}", *chain[-1][11 + k * 15:]])
    texts = [" ".join(x) for x in chain]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert all((a ^ b).bit_count() <= 4 for a, b in zip(prints, prints[1:]))
    sets = [set(minhash.shingles(t, 5).tolist()) for t in texts]
    assert [100 * len(sets[0] & x) >= 80 * len(sets[0] | x) for x in sets] == [True, True, False, False]

    def no_bands(own, signed, percent, words_in, miss, found=None):
        return found
    monkeypatch.setattr(minhash, "links", no_bands)
    for ids in ([1, 2, 3, 4], [1, 2, 3, None]):
        docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
        assert [r.doc_id for r in corpus_pipeline.first_of_near_copies(spark, docs, "").collect()] == [1]


def test_fingerprint_pairs_are_verified_and_lose_no_link(spark):
    rows = sample(random.Random(11))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = docs.select(F.col("doc_id").alias("a"))
    all_of_one = ids.crossJoin(ids.agg(F.min("a").alias("b"))).where("a <> b")    # mostly not similar
    given = {r.id: r.first for r in minhash.near_copies(docs, pairs=all_of_one).collect()}
    assert given == {r.id: r.first for r in minhash.near_copies(docs).collect()} == slow_classes(rows)


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, share in ((5, 3), (150, 140), (150, 100), (5000, 4000)):
        grams = rng.integers(0, 1 << 63, 2 * n, np.uint64)
        x, y = grams[:n], grams[n - share:2 * n - share]
        bits = sum(int(a).bit_count() for a in (minhash.parity(x) ^ minhash.parity(y)).view(np.uint64))
        assert bits <= 2 * (n - share)
    assert bits > 200


def test_few_links_are_joined_as_many_are(spark, monkeypatch):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)]
    frame = staged(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a long, b long").repartition(5), "pairs")
    few = {tuple(r) for r in minhash.joined(frame).collect()}
    monkeypatch.setattr(minhash, "FEW_LINKS", 0)
    assert few == {tuple(r) for r in minhash.joined(frame).collect()} and len(few) > 200
    assert minhash.joined(frame.limit(0)).count() == 0
