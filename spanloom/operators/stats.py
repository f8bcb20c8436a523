"""Corpus statistics, each from one pass over the table it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.text import text_key
from spanloom.operators.filters import of_annotators
from spanloom.operators.views import corpus_support
from spanloom.plans.corpus import Corpus

DEFINED = ("single_label", "multi_label")


def _sum_long(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def unit_counts(text_units: DataFrame) -> DataFrame:
    """Unit counts and distinct-text counts in one row.

    Rows are folded per text first (partial aggregation before the exchange), so
    a distinct count is the number of texts with at least one matching unit.
    """
    sentence, category = F.col("unit_kind") == "sentence", F.col("label_category")
    cases = {
        "sentences": sentence,
        "fragments": F.col("unit_kind") == "fragment",
        "single_label_sentences": sentence & (category == "single_label"),
        "multi_label_sentences": sentence & (category == "multi_label"),
        "unlabeled_sentences": sentence & (category == "unlabeled"),
        "defined_samples": sentence & category.isin(*DEFINED),
        "high_confidence_single": (category == "single_label") & (F.col("annotator_count") >= 2),
    }
    per_text = text_units.withColumns({c: h for c, h in zip(
        ("_h1", "_h2"), text_key(F.col("unit_text")))}).groupBy("_h1", "_h2").agg(
        F.count("*").alias("units"), *[F.count_if(c).alias(n) for n, c in cases.items()])
    unique = {f"unique_{n}": n for n in cases if n != "high_confidence_single"}
    plain = [n for n in cases if n != "defined_samples"]
    return per_text.agg(
        _sum_long(F.col("units")).alias("units"), *[_sum_long(F.col(n)).alias(n) for n in plain],
        *[F.count_if(F.col(n) > 0).alias(u) for u, n in unique.items()])


def span_counts(annotations: DataFrame, annotators: str | None = None) -> DataFrame:
    """Span counts by status and distinct span texts in one row."""
    statuses = ("aligned", "unmatched", "ambiguous")
    per_text = of_annotators(annotations, annotators).select("status", *text_key(F.col("text"))) \
        .groupBy("_h1", "_h2").agg(
        F.count("*").alias("annotations"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return per_text.agg(
        _sum_long(F.col("annotations")).alias("annotations"),
        F.count("*").alias("unique_annotations"),
        *[_sum_long(F.col(s)).alias(s) for s in statuses])


def corpus_counts(corpus: Corpus, annotators: str | None = None) -> DataFrame:
    docs = corpus.documents.agg(F.count("*").alias("documents"))
    return docs.crossJoin(unit_counts(corpus.text_units)).crossJoin(
        span_counts(corpus.annotations, annotators))      # three single rows


def histogram(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def label_distribution(text_units: DataFrame) -> DataFrame:
    """Units per label and how many of them carry no other label."""
    return (text_units.select(F.explode("labels").alias("label"), "label_category")
            .groupBy("label").agg(
                F.count("*").alias("count"),
                F.count_if(F.col("label_category") == "single_label").alias("single_label_count"))
            .orderBy(F.desc("count"), "label"))


def label_counts(text_units: DataFrame) -> DataFrame:
    return label_distribution(text_units).select("label", F.col("count").alias("unit_count"))


def fragment_types(text_units: DataFrame) -> DataFrame:
    """Fragments per type. The count carries the condition: a filter on the type
    would be pushed below and make freshly classified units be typed twice."""
    return (text_units.groupBy("fragment_type")
            .agg(F.count_if(F.col("unit_kind") == "fragment").alias("n")).where("n > 0")
            .orderBy(F.desc("n"), "fragment_type"))


def annotator_profile(annotations: DataFrame) -> DataFrame:
    """Spans, documents and labels per annotator.

    Folded to (annotator, document) first: two distinct counts then need no
    copy of every span.
    """
    per_doc = annotations.groupBy("ranumb", "doc_id").agg(
        F.count("*").alias("n"), F.collect_set("label").alias("labels"))
    spans = per_doc.groupBy("ranumb").agg(_sum_long(F.col("n")).alias("n"),
                                          F.count("*").alias("docs"))
    labels = (per_doc.select("ranumb", F.explode("labels").alias("label")).distinct()
              .groupBy("ranumb").agg(F.count("*").alias("labels")))
    return spans.join(labels, "ranumb").orderBy("ranumb")


def span_label_distribution(annotations: DataFrame, annotators: str | None = None) -> DataFrame:
    return (of_annotators(annotations, annotators).groupBy("label")
            .agg(F.count("*").alias("count")).orderBy("label"))


def status_by_label(annotations: DataFrame, annotators: str | None = None) -> DataFrame:
    statuses = ("aligned", "unmatched", "ambiguous")
    return of_annotators(annotations, annotators).groupBy("label").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def hits_by_label(text_units: DataFrame) -> DataFrame:
    return (text_units.where(F.col("label_category").isin(*DEFINED))
            .select(F.explode("labels").alias("label"))
            .groupBy("label").agg(F.count("*").alias("hits")))


def star_histogram(corpus: Corpus, threshold: int | None = 1) -> DataFrame:
    """Units and distinct texts per category and best agreement tier."""
    best = corpus_support(corpus, threshold).groupBy("unit_id").agg(F.max("stars").alias("stars"))
    units = corpus.text_units.where(F.col("label_category").isin(*DEFINED)).select(
        "unit_id", "label_category", *text_key(F.col("unit_text")))
    per_text = units.join(best, "unit_id").groupBy("label_category", "stars", "_h1", "_h2").agg(
        F.count("*").alias("n"))
    return per_text.groupBy("label_category", "stars").agg(
        _sum_long(F.col("n")).alias("units"), F.count("*").alias("texts"))


def label_matrix(corpus: Corpus) -> DataFrame:
    """Per label: spans and units in the raw, overlap, exclusion and inconclusive
    states, with each count's share of the total and of the largest label.

    Spans and units are read once each: a unit also gives a row without a label,
    and these rows make up the totals.
    """
    statuses = ("aligned", "unmatched", "ambiguous")
    by_span = corpus.annotations.groupBy("label").agg(
        F.count("*").alias("raw"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    defined = F.col("label_category").isin(*DEFINED)
    by_unit = corpus.text_units.select(
        "unit_kind", "label_category",
        F.explode(F.concat("labels", F.array(F.lit(None).cast("string")))).alias("label")).groupBy("label").agg(
        F.count("*").alias("sentences"), F.count_if(defined).alias("hits"),
        F.count_if(F.col("unit_kind") == "sentence").alias("_kind"))
    counts = ["raw", *statuses, "sentences", "hits"]
    every = Window.partitionBy()                        # one row per label
    total = F.col("label").isNull()
    table = by_span.where("label IS NOT NULL").join(by_unit, "label", "full").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts}).withColumns({
            "_sentences": F.max(F.when(total, F.col("_kind"))).over(every),
            "_defined": F.max(F.when(total, F.col("hits"))).over(every)}).where(~total)
    spans = ["raw", *statuses]

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return table.select(
        "label", *counts,
        *[share(F.col(c), F.sum(c).over(every)).alias(f"{c}_share") for c in spans],
        share(F.col("sentences"), F.col("_sentences")).alias("sentences_share"),
        share(F.col("hits"), F.col("_defined")).alias("hits_share"),
        *[(F.col(c) / F.greatest(F.max(c).over(every), F.lit(1))).alias(f"{c}_of_max")
          for c in counts])


def document_summary(corpus: Corpus, doc_ids=None) -> DataFrame:
    """Per document: span counts by status and sentence counts by category."""
    units, spans = corpus.text_units, corpus.annotations
    if doc_ids is not None:
        units = units.where(F.col("doc_id").isin(*doc_ids))
        spans = spans.where(F.col("doc_id").isin(*doc_ids))
    u = units.groupBy("doc_id").agg(
        F.count_if(F.col("unit_kind") == "sentence").alias("sentences"),
        F.count_if(F.col("unit_kind") != "sentence").alias("fragments"),
        *[F.count_if((F.col("unit_kind") == "sentence") & (F.col("label_category") == c)).alias(c)
          for c in ("single_label", "multi_label", "unlabeled")])
    s = spans.groupBy("doc_id").agg(
        *[F.count_if(F.col("status") == x).alias(x) for x in ("aligned", "unmatched", "ambiguous")],
        F.count_distinct("label").alias("labels"))
    numbers = ["aligned", "unmatched", "ambiguous", "labels"]
    return u.join(s, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})


def document_labels(corpus: Corpus, doc_ids=None) -> DataFrame:
    """Sentences per (document, label)."""
    units = corpus.text_units.where("unit_kind = 'sentence'")
    if doc_ids is not None:
        units = units.where(F.col("doc_id").isin(*doc_ids))
    return (units.select("doc_id", F.explode("labels").alias("label"))
            .groupBy("doc_id", "label").agg(F.count("*").alias("n")))


DOC_BUCKET = 1 << 16


def document_neighbours(documents: DataFrame) -> DataFrame:
    """Previous and next document in (subset, num) order.

    The order is cut into number ranges; each range is one window group and only
    the first and last document of every range meet in one small window.
    """
    docs = documents.select("doc_id", "subset", "num",
                            F.floor(F.col("num") / DOC_BUCKET).alias("_b"))
    inside = Window.partitionBy("subset", "_b").orderBy("num")
    edges = docs.groupBy("subset", "_b").agg(F.min_by("doc_id", "num").alias("first"),
                                             F.max_by("doc_id", "num").alias("last"))
    ranges = Window.partitionBy().orderBy("subset", "_b")     # one row per range
    edges = edges.select("subset", "_b", F.lag("last").over(ranges).alias("before"),
                         F.lead("first").over(ranges).alias("after"))
    near = docs.withColumns({"_prev": F.lag("doc_id").over(inside),
                             "_next": F.lead("doc_id").over(inside)})
    return near.join(edges, ["subset", "_b"]).select(
        "doc_id", F.coalesce("_prev", "before").alias("prev_id"),
        F.coalesce("_next", "after").alias("next_id"))
