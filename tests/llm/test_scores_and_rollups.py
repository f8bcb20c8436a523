import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import quality, rollups
from spanloom.llm.queries import QUERIES
from spanloom.session import shared_dir

SF = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    rows = QUERIES["op4_pairwise_quality"](spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in tested]) > 0.97


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, "Good words, like these."), (2, "a | b | c | d"),
                                  (3, "x " * 50000), (4, " \n ")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = quality.scores(docs, none).collect()
    assert len(rows) == 6 and all(abs(r.score - 0.7) < 1e-9 for r in rows)
    assert quality.keep_good(docs, none).count() == 6
    one_sided = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None)], "doc_id long, label int")
    assert all(abs(r.score - 0.7) < 1e-9 for r in quality.scores(docs, one_sided).collect())
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in quality.scores(docs, both).collect())
    assert quality.scores(docs.limit(0), both).count() == 0


def test_ranking_learns_preferences_and_its_gap():
    deal = np.random.default_rng(1)
    good, poor = deal.normal(1, 1, (200, 3)), deal.normal(-1, 1, (100, 3))
    w = quality.bradley_terry(good, poor)
    assert (w > 0).all() and np.mean((good @ w)[:, None] > poor @ w) > 0.95
    assert quality.quantile_gap(np.array([0, 1, 2, 10, 11, 12, 13, 14, 15, 16.0]), 0.3) == 6.0


def test_threshold_is_of_all_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = quality.training_labels(spark.read.parquet(f"{SF}/labels.parquet"))
    table = quality.feature_table(docs, ["doc_id"]).toPandas()
    known = table.merge(labels.toPandas().dropna(), on="doc_id")
    x, y = known[[f"f_{f}" for f in quality.FEATURES]].to_numpy(), known["label"].to_numpy()
    found = quality.fit(spark.createDataFrame(table), labels, sample=60)
    assert np.allclose(found.means, x.mean(axis=0)) and np.allclose(found.scales[x.std(axis=0) > 1e-9],
                                                                    x.std(axis=0)[x.std(axis=0) > 1e-9])
    worth = np.sort((x - found.means) / found.scales @ found.weights)
    assert abs(found.threshold - quality.quantile_gap(worth, float((y == 0).mean()))) < 1e-9


@pytest.mark.parametrize("share", [0.02, 0.3, 0.97])
def test_quantile_gap_over_ranges(spark, share):
    deal = np.random.default_rng(3)
    values = np.r_[deal.normal(0, 1, 3000), np.repeat(0.25, 400), -0.5].round(3)
    rows = spark.createDataFrame([(float(v),) for v in values], "worth double")
    rows = rows.repartition(5)
    assert abs(quality.quantile_gap_of(rows, len(values), share)
               - quality.quantile_gap(np.sort(values), share)) < 1e-12


def test_rollup_of_changes(spark):
    rollup = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    with pytest.raises(ValueError):
        rollup.totals()

    def docs(*rows):
        return spark.createDataFrame([(*r, "t") for r in rows],
                                     "doc_id long, source string, lang string, text string, op string")

    def totals():
        return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_chars)
                for r in rollup.totals().collect()}
    load = rollups.counts(docs((1, "s", "en", "a b c"), (2, "s", "en", None), (3, None, None, "x  y\n"),
                               (None, "s", "en", "no id"), (1, "s", "en", "a b c")), "words-1")
    assert rollup.apply("1", load) and not rollup.apply("1", load)
    assert totals() == {("s", "en", "words-1"): (3, 5, 10), (None, None, "words-1"): (1, 2, 5)}
    revised = rollups.counts(docs((1, "q", "en", "a")), "words-1", version=2).unionByName(
        rollups.counts(docs((1, "late", "en", "a b c d")), "words-1", version=1))
    assert rollup.apply("2", revised)
    assert totals() == {("s", "en", "words-1"): (2, 2, 5), ("q", "en", "words-1"): (1, 1, 1),
                        (None, None, "words-1"): (1, 2, 5)}
    gone = rollups.deletes(spark.createDataFrame([(3,), (99,)], "doc_id long"), "words-1")
    assert rollup.apply("3", gone) and rollup.apply("4", load.limit(0))
    assert totals() == {("s", "en", "words-1"): (2, 2, 5), ("q", "en", "words-1"): (1, 1, 1)}
    assert rollup.apply("5", rollups.counts(docs((3, "s", "de", "w")), "words-1"))
    assert totals()["s", "de", "words-1"] == (1, 1, 1)
    with pytest.raises(ValueError):
        rollup.apply("0", load)
    assert not rollup.apply("1", load) and rollup.batches() == ["1", "2", "3", "4", "5"]


def test_failed_batch_is_written_anew(spark):
    rollup = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    docs = spark.createDataFrame([(1, "s", "en", "a b")], "doc_id long, source string, lang string, text string")
    load = rollups.counts(docs, "words-1")
    load.write.parquet(f"{rollup.folder}/deltas/1")            # left by a run that did not commit
    assert rollup.apply("1", load)
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "words-1", 1, 2, 3)]


# ---- the pipeline against plain Python -------------------------------------

def test_pipeline(spark, tmp_path):
    from tests.llm.test_minhash import slow_classes
    from tests.llm.test_texts import LIBRARY, slow_hits, slow_lines

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, sf)
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        found.write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert found.columns == names
            after = sorted((r.doc_id, r.text) for r in found.select("doc_id", "text").collect())
        if k == 0:
            scored = {r.doc_id: r.predicted for r in QUERIES["op4_pairwise_quality"](spark, sf).collect()}
            assert after == sorted(x for x in before if scored[x[0]]) and len(after) < len(before)
        if k == 1:
            assert after == sorted(x[:2] for x in slow_lines(before)) and after != sorted(before)
            assert found.where("n_chars <> length(text)").count() == 0
        if k == 2:
            group = slow_classes(before, link_empty=True)
            assert after == sorted(x for x in before if group[x[0]] == x[0])
        if k == 3:
            hit = {x[0] for x in slow_hits(before, items, 10) if x[2]}
            assert after == sorted(x for x in before if x[0] not in hit)
        if k == 4:
            rows = {r.doc_id: r.n_tokens for r in found.collect()}
            assert rows == {i: len(LIBRARY.encode(t, add_special_tokens=False).ids) for i, t in before}
        docs = found
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
