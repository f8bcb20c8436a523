"""Row views: units, documents, spans and their pages."""

from __future__ import annotations

from dataclasses import replace
from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.operators import evidence
from spanloom.operators.filters import UnitFilter, filter_documents, filter_spans, filter_units
from spanloom.operators.paging import locate, locate_all
from spanloom.plans.corpus import Corpus


def joined(values: Column) -> Column:
    """``;``-joined list, NULL when empty."""
    return F.nullif(F.array_join(values, ";"), F.lit(""))


def page(df: DataFrame, order: list, limit: int | None, offset: int = 0) -> DataFrame:
    """Ordered rows; with a limit a top-k instead of a full sort."""
    df = df.orderBy(*order).offset(offset)
    return df if limit is None else df.limit(limit)


def verbatim_label() -> Column:
    return (F.when((F.col("label_category") == "single_label") & (F.size("labels") == 1),
                   F.get("labels", F.lit(0)))
            .when(F.col("label_category") == "multi_label", "MULTI_LABEL").otherwise(""))


def unit_view(units: DataFrame, *extra: Column) -> DataFrame:
    return units.select(
        "unit_id", "doc_id", "subset", "position", "block_kind", "unit_text", "unit_kind",
        "fragment_type", "label_category", "annotator_count", "source_annotation_count",
        "alignment_types", joined(F.col("labels")).alias("verbatim_labels"),
        joined(F.col("annotators")).alias("annotators"),
        F.col("unit_text").alias("text"), verbatim_label().alias("verbatim_label"), *extra)


def corpus_support(corpus: Corpus, threshold: int | None = 1, only: Column | None = None) -> DataFrame:
    """Support of every labelled unit, or of those that a condition on ``doc_id`` leaves."""
    ladder = corpus.ladder if only is None else corpus.ladder.where(only)
    return evidence.support_at(ladder, threshold)


def with_support(units: DataFrame, corpus: Corpus, threshold: int | None = 1,
                 only: Column | None = None) -> DataFrame:
    """Attach support pairs, best stars and best vote count (NULL when none)."""
    pairs = evidence.support_by_unit(corpus_support(corpus, threshold, only))
    return units.join(pairs, ["doc_id", "unit_id"], "left")


def units(corpus: Corpus, f: UnitFilter = UnitFilter(), limit: int | None = 50,
          offset: int = 0) -> DataFrame:
    """One page of matching units in (doc_id, position) order, with support.

    A page reads the documents that hold it, of the units and of the votes.
    """
    rows, order = filter_units(corpus, f), ["doc_id", "position"]
    if limit is None:
        return with_support(unit_view(page(rows, order, None, offset)), corpus, f.threshold)
    whole = replace(f, evidence_threshold=None) == UnitFilter()
    only, skip = (locate_all(corpus.page_index, "units", offset, limit) if whole and not f.narrows_evidence
                  else locate(corpus.page_index, rows, offset, limit))
    return with_support(unit_view(page(rows.where(only), order, limit, skip)), corpus, f.threshold, only)


def unit_total(corpus: Corpus, f: UnitFilter = UnitFilter()) -> DataFrame:
    return filter_units(corpus, f).agg(F.count("*").alias("total"))


def _of(df: DataFrame, column: str, ids: Iterable[str] | None) -> DataFrame:
    return df if ids is None else df.where(F.col(column).isin(*ids))


def unit_spans(corpus: Corpus, unit_ids: Iterable[str] | None = None) -> DataFrame:
    """Spans behind the given units (all units without ids)."""
    text = corpus.annotations.select("doc_id", "annotation_id", "text")
    return (_of(corpus.alignment, "unit_id", unit_ids).join(text, ["doc_id", "annotation_id"])
            .select("unit_id", "annotation_id", "ranumb", "text", "label", "alignment_type"))


def span_units(corpus: Corpus, annotation_ids: Iterable[str] | None = None) -> DataFrame:
    """Units the given spans are aligned to, one row each."""
    u = corpus.text_units.select("doc_id", "unit_id", "position", "unit_text", "fragment_type",
                                 "label_category")
    return (_of(corpus.alignment, "annotation_id", annotation_ids).join(u, ["doc_id", "unit_id"])
            .select("annotation_id", "unit_id", "position", "unit_text", "unit_kind",
                    "fragment_type", "label_category", "alignment_type"))


def document_rollup(corpus: Corpus) -> DataFrame:
    """Per document: sentences, fragments, spans, labels, aligned spans."""
    per_units = corpus.text_units.groupBy("doc_id").agg(
        F.count_if(F.col("unit_kind") == "sentence").alias("sentence_count"),
        F.count_if(F.col("unit_kind") == "fragment").alias("fragment_count"))
    per_spans = corpus.annotations.groupBy("doc_id").agg(
        F.count("*").alias("annotation_count"),
        F.count_distinct("label").alias("label_count"),
        F.count_if(F.col("status") == "aligned").alias("aligned_count"))
    counts = ["sentence_count", "fragment_count", "annotation_count", "label_count",
              "aligned_count"]
    return (corpus.documents.select("doc_id", "subset", "num", "title", "link", "is_homepage")
            .join(per_units, "doc_id", "left").join(per_spans, "doc_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}))


# --- fixed values: sort keys ------------------------------------------------
SORT_KEYS = {"sentence_count": "sentence_count", "sentences": "sentence_count",
             "fragment_count": "fragment_count", "fragments": "fragment_count",
             "annotation_count": "annotation_count", "annotations": "annotation_count"}
# --- end of fixed values ----------------------------------------------------


def documents(corpus: Corpus, subset: str | None = None, q: str | None = None,
              sort: str | None = None, order: str = "asc", limit: int | None = 50,
              offset: int = 0) -> DataFrame:
    """Document list with its counts, filtered before anything is counted."""
    kept = filter_documents(corpus.documents, subset, q)
    if subset or q:
        ids = kept.select("doc_id")
        corpus = replace(corpus, documents=kept,
                         annotations=corpus.annotations.join(ids, "doc_id", "left_semi"),
                         text_units=corpus.text_units.join(ids, "doc_id", "left_semi"))
    return page(document_rollup(corpus), document_keys(sort, order), limit, offset)


def document_keys(sort: str | None, order: str) -> list[Column]:
    """Order of a document list: by a count, or by subset and number."""
    down = order.lower() == "desc"

    def key(c: str) -> Column:
        return F.col(c).desc() if down else F.col(c).asc()

    if sort in SORT_KEYS:
        return [key(SORT_KEYS[sort]), F.col("subset"), F.col("num")]
    if sort in ("doc_id", "id"):
        return [key("subset"), key("num")]
    return [F.col("subset"), F.col("num")]


def page_ids(documents: DataFrame, counts: DataFrame | None, sort: str | None, order: str,
             limit: int, offset: int = 0) -> list[str]:
    """Ids of the documents of one page, at most ``limit``.

    ``counts`` (doc_id, and the count that the page is sorted by) lacks documents without rows.
    """
    rows = documents.select("doc_id", "subset", "num")
    if sort in SORT_KEYS:
        rows = rows.join(counts, "doc_id", "left").fillna(0, [SORT_KEYS[sort]])
    return [r[0] for r in page(rows, document_keys(sort, order), limit, offset).select("doc_id").collect()]


def document_order(corpus: Corpus) -> DataFrame:
    return corpus.documents.select("doc_id", "subset", "num").orderBy("subset", "num")


def document_detail(corpus: Corpus, doc_ids: Iterable[str]) -> dict[str, DataFrame]:
    """Document, spans by source row and units by position, as three frames."""
    ids = list(doc_ids)
    return {
        "document": _of(corpus.documents, "doc_id", ids),
        "annotations": _of(corpus.annotations, "doc_id", ids).orderBy("doc_id", "src_row"),
        "units": _of(corpus.text_units, "doc_id", ids)
        .withColumn("verbatim_labels", joined(F.col("labels"))).orderBy("doc_id", "position"),
    }


def rendered(corpus: Corpus, doc_ids: Iterable[str] | None = None) -> DataFrame:
    """Units under their block, one row per unit so that any document size works.

    ``opens_block`` is true for the first unit of a block: a unit opens a block
    exactly when it has its block's lowest position.
    """
    rows = _of(corpus.text_units, "doc_id", doc_ids)
    first = rows.groupBy("doc_id", "block_seq").agg(F.min("position").alias("_first"))
    return rows.join(first, ["doc_id", "block_seq"]).select(
        "doc_id", "block_seq", "block_kind", (F.col("position") == F.col("_first")).alias("opens_block"),
        "unit_id", "position", "unit_text", "unit_kind", "fragment_type", "label_category",
        "annotator_count", joined(F.col("labels")).alias("verbatim_labels"))


def document_spans(corpus: Corpus, doc_ids: Iterable[str] | None = None,
                   ranumb: str | None = None, label: str | None = None) -> DataFrame:
    """Spans of documents with their aligned units: one row per (span, unit)."""
    spans = _of(filter_spans(corpus.annotations, ranumb=ranumb, label=label), "doc_id", doc_ids)
    units_of = corpus.alignment.select("doc_id", "annotation_id", "unit_id")
    return spans.join(units_of, ["doc_id", "annotation_id"], "left").select(
        "annotation_id", "doc_id", "src_row", "ranumb", "text", "label", "status", "unit_id")


def spans(corpus: Corpus, limit: int | None = 100, offset: int = 0, **conditions) -> DataFrame:
    """One page of spans in (doc_id, src_row) order; it reads the documents that hold it."""
    rows, order = filter_spans(corpus.annotations, **conditions), ["doc_id", "src_row"]
    if limit is None:
        return page(rows, order, None, offset)
    only, skip = (locate(corpus.page_index, rows, offset, limit) if any(conditions.values())
                  else locate_all(corpus.page_index, "spans", offset, limit))
    return page(rows.where(only), order, limit, skip)


def with_matched_units(span_page: DataFrame, corpus: Corpus) -> DataFrame:
    """Add the ``;``-joined candidate units of ambiguous spans, by position.

    For pages: one list is built per span text. The long form is ``corpus.ambiguous``.
    """
    key = ["doc_id", "span_rep"]
    lists = (corpus.ambiguous.join(span_page.select(*key), key, "left_semi")
             .groupBy(*key).agg(F.array_sort(F.collect_list(
                 F.struct("position", "unit_id"))).alias("_m")))
    return (span_page.join(lists, key, "left")
            .withColumn("matched_units", F.array_join(F.col("_m.unit_id"), ";")).drop("_m"))
