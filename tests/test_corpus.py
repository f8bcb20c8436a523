"""A corpus folder read, built, queried, exported and read back."""

import json
import os
from dataclasses import fields, replace

import pytest
from pyspark.sql import functions as F

from spanloom.operators import checks, evidence, manifest, search, stats, views
from spanloom.operators.filters import UnitFilter, filter_units, name_list
from spanloom.operators.html_blocks import parse_pages
from spanloom.plans import corpus as C, export as X
from spanloom.session import forget
from spanloom.sources import files

SENTENCES = ["We may collect your personal data every day.", "You can delete the data at any time.",
             "We will share the records with our partners."]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    for subset in ("DB", "WS"):
        for kind in ("Htmls", "Annotations"):
            os.makedirs(f"{root}/{kind}/{subset}")
        for num in range(1, 6):
            with open(f"{root}/Htmls/{subset}/{num}.html", "wb") as f:
                f.write(("<html><head><title>T %d</title></head><body><h1>Policy</h1>%s</body></html>" % (
                    num, "".join(f"<p>{s}</p>" for s in SENTENCES))).encode() + b"\xff")
            if num == 5:
                continue            # page without annotations: not part of the corpus
            with open(f"{root}/Annotations/{subset}/{num}.csv", "w", newline="") as f:
                f.write("RANumb,Text,Label\r\n")
                f.write(f'ra1,"{SENTENCES[0]}",Others\r\nra2," collect your\nPersonal data ", Others \r\n')
                f.write(f'ra1,"{SENTENCES[1]}",Methods to exercise rights\r\nra1,,Others\r\nra3,noise here now,Others\r\n')
                f.write(f'ra2,"{SENTENCES[1]}",Others\r\nra2,data,Others\r\n')
    os.makedirs(f"{root}/Crawl")
    with open(f"{root}/Crawl/db.csv", "w") as f:
        f.write("Link,IsHomepage,Textmatch_P,Textmatch_S,Textmatch_PP,Link_Match\n http://one ,y,,,,\nhttp://two,n,,,,\n")
    pages = parse_pages(files.read_pages(spark, root))
    spans = files.usable_spans(files.read_span_rows(spark, root))
    docs = pages.drop("blocks", "source_csv")
    out = str(tmp_path_factory.mktemp("tables"))
    return C.build(docs, pages.select("doc_id", "subset", "blocks"), spans, out)


def test_sources(corpus):
    docs = {r.doc_id: r for r in corpus.documents.collect()}
    assert len(docs) == 8 and docs["DB_1"].link == "http://one" and docs["DB_3"].link is None
    assert docs["WS_2"].title == "T 2"
    spans = corpus.annotations.where("doc_id = 'DB_1'").collect()
    assert sorted(r.src_row for r in spans) == [0, 1, 2, 4, 5, 6]
    status = {r.src_row: (r.status, r.label) for r in spans}
    assert status[1] == ("aligned", "Others") and status[4][0] == "unmatched" and status[6][0] == "ambiguous"


def test_units_and_checks(corpus):
    units = {r.unit_id: r for r in corpus.text_units.where("doc_id = 'WS_1'").collect()}
    assert units["WS_1_U1"].fragment_type == "heading" and units["WS_1_U1"].label_category == "not-eligible"
    assert units["WS_1_U2"].label_category == "single_label" and units["WS_1_U2"].annotator_count == 2
    assert units["WS_1_U3"].label_category == "multi_label"
    assert units["WS_1_U4"].label_category == "unlabeled"
    assert checks.integrity(corpus).where("violations > 0").count() == 0


def test_filters(corpus):
    def n(**kw):
        return filter_units(corpus, UnitFilter(**kw)).count()
    assert n() == 32 and n(subset="DB") == 16 and n(high_confidence=True) == 8
    assert n(sample_view="null", labels="Others") == 0
    assert n(sample_view="bogus", labels="Others") == 16
    assert n(sample_view="single,multi") == 16 and n(sample_view="single,multi", min_support=2) == 8
    assert n(exclude_labels="Methods to exercise rights") == 8
    assert n(q="COLLECT your") == 8 and n(q="%") == 0
    assert name_list(["a, b", "c,,"]) == ["a", "b", "c"]


def test_views_and_search(corpus):
    page = views.units(corpus, UnitFilter(labels="Others"), limit=3, offset=1).collect()
    assert [r.unit_id for r in page] == ["DB_1_U3", "DB_2_U2", "DB_2_U3"]
    assert page[0].verbatim_label == "MULTI_LABEL" and len(page[0].support) == 2
    assert views.documents(corpus, q="h__p://", limit=None).count() == 2
    found = search.search(corpus, "personal")
    assert found["units"].count() == 6 and search.search(corpus, "a")["units"].count() == 0
    spans = views.with_matched_units(views.spans(corpus, limit=6, doc_id="DB_1"), corpus).collect()
    assert [r.matched_units for r in spans][-1] == "DB_1_U2;DB_1_U3"
    assert stats.corpus_counts(corpus).first().unique_sentences == 3
    neighbours = {r.doc_id: (r.prev_id, r.next_id) for r in stats.document_neighbours(corpus.documents).collect()}
    assert neighbours["DB_4"] == ("DB_3", "WS_1") and neighbours["DB_1"][0] is None


def test_manifest(corpus, spark):
    m = manifest.build_manifest(corpus, "1", expected_docs=8)
    assert manifest.check_manifest(m, "1")["ok"]
    assert manifest.check_manifest(m, "2")["reason"] == "version_mismatch"
    assert manifest.check_manifest(None, "2")["reason"] == "missing"
    assert manifest.check_manifest(m.where("key = 'counts'"), "2")["reason"] == "missing_version"
    counts = json.loads(m.where("key = 'counts'").first().value)
    assert counts["documents"] == 8 and counts["subsets"] == {"DB": 4, "WS": 4}
    with pytest.raises(Exception, match="below expected"):
        manifest.build_manifest(corpus, "1", expected_docs=400).collect()
    counted = manifest.row_counts(corpus)
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == len(manifest.TABLES) and "ReadSchema: struct<count(*)" in plan
    assert {r.table: r.n for r in counted.collect()} == {t: getattr(corpus, t).count() for t in manifest.TABLES}
    small = manifest.corpus_slice(corpus, 1)
    assert small.documents.count() == 2 and small.text_units.count() == 8
    a = manifest.fingerprint(corpus.text_units, ["unit_id", "unit_text"]).first()
    assert a == manifest.fingerprint(corpus.text_units.repartition(3), ["unit_id", "unit_text"]).first()
    changed = corpus.text_units.withColumn("unit_text", F.when(F.col("unit_id") == "DB_1_U1", "x").otherwise(F.col("unit_text")))
    assert a != manifest.fingerprint(changed, ["unit_id", "unit_text"]).first()


def test_export_round_trip(corpus, spark, tmp_path):
    f = UnitFilter(sample_view="single,multi")
    o = X.ExportOptions(train=50, eval=25, test=25, fields="id,label,support_stars,bogus,split")
    meta = X.export(corpus, str(tmp_path / "csv"), f, o).first()
    back = spark.read.option("header", True).csv(str(tmp_path / "csv" / "data"))
    assert back.count() == 16 == meta.total and set(back.columns) == {"id", "label", "support_stars", "split", "part"}
    assert "METHODS_TO_EXERCISE_RIGHTS; OTHERS" in {r.label for r in back.collect()}
    assert sum(meta.counts) == 16 and all(c > 0 for c in meta.counts)
    X.export(corpus, str(tmp_path / "json"), f, X.ExportOptions(format="json", split=False))
    js = spark.read.json(str(tmp_path / "json" / "data"))
    assert dict(js.dtypes)["label"] == "array<string>" and {r.split for r in js.collect()} == {"data"}


def test_export_rows_have_the_selected_columns(corpus, spark, monkeypatch):
    from spanloom.plans import catalog
    monkeypatch.setattr(catalog, "built", lambda *_: corpus)
    rows = catalog.QUERIES["export_rows"](spark, "")
    assert rows.columns == ["id", "group", "text", "label", "label_name", "support_stars", "support_evidence",
                            "alignment_types", "split"]
    assert rows.where("split <> 'data'").count() == 0


def test_overlaps_read_written_texts(corpus, spark, monkeypatch):
    """The rules for characters run once, not in every branch of the overlap join."""
    from spanloom.plans import catalog
    monkeypatch.setattr(catalog, "built", lambda *_: corpus)
    found = catalog.QUERIES["overlap_best"](spark, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_nfkc" not in plan and "ArrowEvalPython" not in plan
    assert {r.unit_rep for r in found.where("doc_id = 'WS_1' and span_rep = 0").collect()} == {2}


def test_short_queries_find_nothing(corpus):
    assert search.search_all(corpus, " a ").count() == 0


def test_failed_build_leaves_the_last_version(corpus, spark, tmp_path):
    found = C.Corpus.load(spark, str(tmp_path)) if (tmp_path / "versions").exists() else None
    assert found is None
    paths = {p.split("/version-")[0] for p in corpus.text_units.inputFiles()}
    assert len(paths) == 1
    folder = paths.pop()
    spark.range(3).write.parquet(f"{folder}/version-half/text_units")     # not in the list of versions
    again = C.Corpus.load(spark, folder)
    assert again.text_units.count() == corpus.text_units.count()
    assert not [d for d in os.listdir(folder.removeprefix("file://")) if d.startswith("work")]


def test_preview(corpus):
    assert X.preview(corpus, o=X.ExportOptions(train=80, eval=15, test=15))["valid"] is False
    assert X.preview(corpus, UnitFilter(subset="none"))["total_units"] == 0
    p = X.preview(corpus, UnitFilter(doc_id="DB_1"), X.ExportOptions(train=70, eval=15, test=15))
    assert p["valid"] and p["counts"] == {"train": 4} and len(p["warnings"]) == 2
    p = X.preview(corpus, o=X.ExportOptions(max_doc_label_pct=25, exclude_other=True))
    assert p["valid"] is False
    p = X.preview(corpus, o=X.ExportOptions(max_doc_label_pct=25))
    assert p["original_total"] == 32 and p["capped_units_removed"] == 16
    assert p["cross_split_text_overlap"]["has_overlap"]


# ---- layout ------------------------------------------------------------------

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_joins_by_document_need_no_exchange(corpus, no_broadcast):
    for df in (views.unit_spans(corpus), views.span_units(corpus), views.document_rollup(corpus),
               views.corpus_support(corpus, 2), views.document_spans(corpus),
               filter_units(corpus, UnitFilter(sample_view="single", min_support=2)),
               views.with_support(corpus.text_units, corpus, 1)):
        text = plan(df)
        assert "Join" in text or df.columns[:3] == ["doc_id", "unit_id", "label"]
        assert "Exchange" not in text, text


def test_tables_are_opened_by_path(corpus, spark, no_broadcast):
    folder = corpus.text_units.inputFiles()[0].split("/version-")[0]
    other = spark.newSession()
    for f in fields(C.Corpus):                          # as in a session that has not seen them
        path = getattr(corpus, f.name).inputFiles()[0].partition(f"/{f.name}/")[0] + f"/{f.name}"
        forget(spark, path)
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    other.conf.set("spark.sql.shuffle.partitions", "7")
    again = C.Corpus.load(other, folder)
    assert again.text_units.count() == 32 and again.annotations.count() == 48
    assert "Exchange" not in plan(views.unit_spans(again))
    assert views.unit_spans(again).count() == again.alignment.count() > 0
    for f in fields(C.Corpus):                          # for the tests after this one
        setattr(corpus, f.name, getattr(C.Corpus.load(spark, folder), f.name))


def test_plain_tables_give_the_same_rows(corpus, spark, tmp_path):
    docs = corpus.documents.where("doc_id = 'DB_1'")
    units = corpus.text_units.where("doc_id = 'DB_1'").orderBy("position").collect()
    blocks = spark.createDataFrame([("DB_1", "DB", [(r.block_kind, r.unit_text) for r in units])],
                                   "doc_id string, subset string, blocks array<struct<kind: string, text: string>>")
    spans = corpus.annotations.where("doc_id = 'DB_1'").drop("status", "n_hits", "span_rep")
    built = [C.build(docs, blocks, spans, str(tmp_path / str(n)), buckets=n) for n in (0, 3)]
    for f in fields(C.Corpus):
        if f.name not in ("documents",):
            a, b = (sorted(map(str, getattr(c, f.name).select(sorted(getattr(c, f.name).columns)).collect())) for c in built)
            assert a == b, f.name


# ---- pages ---------------------------------------------------------------------

def test_pages_equal_the_ordered_rows(corpus, monkeypatch):
    from spanloom.operators import paging
    order = [r.unit_id for r in corpus.text_units.orderBy("doc_id", "position").collect()]
    spans = [r.annotation_id for r in corpus.annotations.orderBy("doc_id", "src_row").collect()]
    labelled = [r.unit_id for r in filter_units(corpus, UnitFilter(labels="Others")).orderBy("doc_id", "position").collect()]
    for ranges in (4096, 3):
        monkeypatch.setattr(paging, "RANGES", ranges)
        for offset, limit in ((0, 5), (3, 1), (30, 50), (31, 1), (32, 4), (500, 5)):
            found = [r.unit_id for r in views.units(corpus, limit=limit, offset=offset).orderBy("doc_id", "position").collect()]
            assert found == order[offset:offset + limit]
            found = [r.unit_id for r in views.units(corpus, UnitFilter(labels="Others"), limit, offset)
                     .orderBy("doc_id", "position").collect()]
            assert found == labelled[offset:offset + limit]
            found = [r.annotation_id for r in views.spans(corpus, limit, offset).orderBy("doc_id", "src_row").collect()]
            assert found == spans[offset:offset + limit]
    found = [r.annotation_id for r in views.spans(corpus, 4, 2, label="Others").orderBy("doc_id", "src_row").collect()]
    assert found == [r.annotation_id for r in corpus.annotations.where("label = 'Others'")
                     .orderBy("doc_id", "src_row").collect()][2:6]


def test_a_deep_page_reads_the_documents_that_hold_it(corpus):
    total = corpus.text_units.count()
    text = plan(corpus.text_units.where(views.locate_all(corpus.page_index, "units", total - 2, 2)[0]))
    assert "EqualTo(doc_id,WS_4)" in text
    index = plan(corpus.page_index.where("units_before < 10000050 and units_before + n_units > 10000000"))
    assert "PushedFilters: [IsNotNull(units_before)" in index


# ---- votes -----------------------------------------------------------------------

def test_support_at_any_threshold_from_the_ladder(spark):
    import random
    rnd = random.Random(1)
    rows = [("d", f"u{rnd.randrange(4)}", rnd.choice("xy"), f"a{rnd.randrange(4)}") for _ in range(150)]
    votes = spark.createDataFrame(rows, "doc_id string, unit_id string, label string, ranumb string")
    ladder = evidence.vote_ladder(votes, evidence.annotator_pool(votes))
    for t in (None, 1, 2, 5, 9, 50):
        wanted = {}
        for key in {r[1:3] for r in rows}:
            k = len([a for a in {r[3] for r in rows} if rows.count(("d", *key, a)) >= (t or 1)])
            if k:
                wanted[key] = (k, 4, 3 if k == 4 else 2 if k >= 2 else 1)
        found = {(r.unit_id, r.label): (r.k, r.pool, r.stars) for r in evidence.support_at(ladder, t).collect()}
        assert found == wanted


def test_integrity_reads_each_table_once(corpus, spark):
    found = checks.integrity(corpus)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 5
    none = F.lit(None).cast("string")
    bad = replace(corpus, annotations=corpus.annotations.withColumn("doc_id", F.when(F.col("src_row") == 0, none)
                                                                   .otherwise(F.col("doc_id"))),
                  documents=corpus.documents.unionByName(corpus.documents.limit(1)).unionByName(
                      corpus.documents.limit(2).withColumn("doc_id", none)),
                  alignment=corpus.alignment.withColumn("unit_id", F.lit("nowhere")))
    counts = {r.rule: r.violations for r in checks.integrity(bad).collect()}
    assert counts["reference annotations.doc_id"] == 8 and counts["unique documents(doc_id)"] == 2
    assert counts["reference alignment.unit_id"] == corpus.alignment.count()
    assert counts["not null documents"] == 2 and counts["not null annotations"] == 8
    assert counts["reference alignment.annotation_id"] == 0 and counts["domain text_units.fragment_type"] == 0


def test_large_texts_get_more_buckets(spark, tmp_path, monkeypatch):
    from spanloom.plans import catalog
    rows = [(i, f"Line {i} is long enough to be a sentence of it.\nAnd the second one of {i} ends here.", "en", "src", 80)
            for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    plain = catalog.built(spark, str(tmp_path))
    monkeypatch.setattr(catalog, "BUCKET_CHARS", 100)
    monkeypatch.setattr(catalog, "_BUILT", {})
    wide = catalog.built(spark, str(tmp_path))
    buckets = spark.read.parquet(f"{os.path.dirname(wide.folder)}/versions").first()["buckets"]
    assert buckets > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for f in fields(plain):
        a, b = getattr(plain, f.name), getattr(wide, f.name)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert spark.conf.get(C.BY_SPLITS) == "true"


def test_a_page_of_documents_needs_no_whole_corpus(spark, tmp_path, monkeypatch):
    from spanloom.plans import catalog
    line = "We may collect your personal data every day."
    rows = [(i, "\n".join([line] * (1 + i % 7)), "en", "src1" if i % 2 else "src2", 80) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    given = []

    def build(documents, blocks, spans, **_):
        given.extend((d.select("doc_id").distinct().count() for d in (documents, blocks, spans)))
        raise InterruptedError
    monkeypatch.setattr(C, "build", build)
    found = catalog.QUERIES["documents_by_annotation_count"](spark, str(tmp_path)).collect()
    first = sorted(range(60), key=lambda i: (-(1 + i % 7), i))[:30]
    assert [(r["doc_id"], r["fragment_count"], r["annotation_count"]) for r in found] == [
        (f"en_{i}", 0, 3 * (1 + i % 7)) for i in first]
    with pytest.raises(InterruptedError):
        catalog.QUERIES["documents_sorted"](spark, str(tmp_path))
    assert given == [20, 20, 20] and not catalog.is_built(spark, str(tmp_path))


def test_fragments_need_no_alignment(spark, tmp_path):
    from spanloom.plans import catalog
    rows = [(1, "We may collect your personal data every day.\nSign up", "en", "src1", 80)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["units_filter_kind"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [("en_1_U2", "not-eligible", "fragment")]
    assert not catalog.is_built(spark, str(tmp_path))
    assert not UnitFilter(unit_kind="fragment", labels="Others").only_fragments
    assert not UnitFilter(sample_view="fragments,single").only_fragments


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with documents; every third one holds the texts that are searched."""
    rows = [(i, ("Reading the apple is useful to you.\n" if i % 3 == 0 else "") +
             f"We may collect your personal data number {i} every day.\nSign up", "en", "src1", 80) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture
def given(monkeypatch):
    """Documents, blocks and spans that the builds of a test are given."""
    found, build = [], C.build

    def noted(documents, blocks, spans, **options):
        found.append([sorted(r[0] for r in x.select("doc_id").distinct().collect()) for x in (documents, blocks, spans)])
        return build(documents, blocks, spans, **options)
    monkeypatch.setattr(C, "build", noted)
    return found


def test_terms_are_matched_without_a_corpus(spark, lines, given):
    from spanloom.plans import catalog
    found = catalog.QUERIES["match_terms"](spark, lines).collect()
    assert sorted(map(tuple, found)) == sorted(("ing the", f"en_{i}_U1") for i in range(0, 30, 3))
    assert not given


def test_overlaps_need_no_corpus(spark, lines, given):
    from spanloom.plans import catalog
    best = {tuple(r) for r in catalog.QUERIES["overlap_best"](spark, lines).collect()}
    assert not given and not catalog.is_built(spark, lines)
    assert {("en_1", 0, 1), ("en_5", 0, 1), ("en_6", 0, 1), ("en_11", 0, 1), ("en_16", 0, 1)} < best


def test_indexed_searches_align_the_documents_they_find(spark, lines, given):
    from spanloom.plans import catalog
    names = ("search_units_indexed", "units_filter_q_indexed")
    found = [sorted(map(tuple, catalog.QUERIES[n](spark, lines).collect())) for n in names]
    holding = sorted(f"en_{i}" for i in range(0, 30, 3))
    assert given == [[holding[:6]] * 3, [holding] * 3]
    assert [r[0] for r in found[0]] == [f"{d}_U1" for d in holding[:6]] and len(found[1]) == 10
    assert {r[1] for r in found[1]} & {"single_label", "multi_label"} and not catalog.is_built(spark, lines)
