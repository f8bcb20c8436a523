"""Search over documents, labels, annotators and unit texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.rows import exploded
from spanloom.functions.text import ascii_lower, collapse, like_ci
from spanloom.operators.containment import contained_pairs
from spanloom.operators.textindex import literals_of_like
from spanloom.operators.views import joined, verbatim_label
from spanloom.plans.corpus import Corpus
from spanloom.session import write_and_read

# --- fixed values: rows shown per kind --------------------------------------
LIMITS = {"documents": 5, "provisions": 5, "annotators": 5, "units": 6}
# --- end of fixed values ----------------------------------------------------


def search_documents(corpus: Corpus, q: str, limit: int | None = LIMITS["documents"]) -> DataFrame:
    hit = like_ci(F.col("doc_id"), q) | like_ci(F.col("title"), q) | like_ci(F.col("link"), q)
    rows = corpus.documents.where(hit).select("doc_id", "title", "link").orderBy("doc_id")
    return rows if limit is None else rows.limit(limit)


def search_labels(corpus: Corpus, q: str, limit: int | None = LIMITS["provisions"]) -> DataFrame:
    rows = (corpus.annotations.where(like_ci(F.col("label"), q)).groupBy("label")
            .agg(F.count("*").alias("count")).orderBy(F.desc("count"), "label"))
    return rows if limit is None else rows.limit(limit)


def search_annotators(corpus: Corpus, q: str, limit: int | None = LIMITS["annotators"]) -> DataFrame:
    rows = (corpus.annotations.where(like_ci(F.col("ranumb"), q)).groupBy("ranumb")
            .agg(F.count("*").alias("count"), F.count_distinct("doc_id").alias("docs"))
            .orderBy("ranumb"))
    return rows if limit is None else rows.limit(limit)


def search_units(corpus: Corpus, q: str, limit: int | None = LIMITS["units"]) -> DataFrame:
    units = corpus.text_units
    if corpus.text_index:
        units = corpus.text_index.narrowed(units, literals_of_like(q))
    rows = units.where(like_ci(F.col("unit_text"), q)).orderBy("doc_id", "position")
    rows = rows if limit is None else rows.limit(limit)
    return rows.select(
        "unit_id", "doc_id", "unit_text", "unit_kind", "fragment_type", "label_category",
        "position", "block_kind", joined(F.col("labels")).alias("verbatim_labels"),
        verbatim_label().alias("verbatim_label"))


def search(corpus: Corpus, q: str = "") -> dict[str, DataFrame]:
    """All four result lists; queries under two characters find nothing."""
    query = q.strip()
    found = {"documents": search_documents, "provisions": search_labels,
             "annotators": search_annotators, "units": search_units}
    if len(query) < 2:
        return {k: f(corpus, query).limit(0) for k, f in found.items()}
    return {k: f(corpus, query) for k, f in found.items()}


def search_all(corpus: Corpus, q: str = "") -> DataFrame:
    """The four lists as (entity, key, detail) rows."""
    parts = search(corpus, q)
    shape = {"documents": ("doc_id", F.col("link")), "provisions": ("label", F.col("count").cast("string")),
             "annotators": ("ranumb", F.col("count").cast("string")), "units": ("unit_id", F.col("unit_text"))}
    rows = None
    for entity, (key, detail) in shape.items():
        part = parts[entity].select(F.lit(entity).alias("entity"), F.col(key).alias("key"),
                                    detail.alias("detail"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def match_term_table(units: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, unit_id): which units hold which terms of a table (term_id, term).

    Both are compared in lower case (A-Z) and with single spaces; equal unit texts
    are folded first. Any number of terms: they are joined by anchors, not by pairs.
    """
    hay = units.select("unit_id", collapse(ascii_lower(F.col("unit_text"))).alias("hay_text")).where("hay_text <> ''")
    texts = write_and_read(hay.groupBy("hay_text").agg(F.min("unit_id").alias("hay_id")), "term_texts")
    needles = terms.select(F.col("term_id").alias("needle_id"), collapse(ascii_lower(F.col("term")))
                           .alias("needle_text")).where("needle_text <> ''")
    found = contained_pairs(needles, texts, [])
    return found.join(hay, "hay_text").select(F.col("needle_id").alias("term_id"), "unit_id")


def match_terms(units: DataFrame, terms: list[str]) -> DataFrame:
    """Units holding each of several literal terms, in one scan.

    The terms are request parameters and travel in the plan, not as a table.
    """
    asked = F.array(*[F.lit(t) for t in terms])
    text = ascii_lower(F.col("unit_text"))
    hits = F.filter(asked, lambda t: F.contains(text, ascii_lower(t)))
    return exploded(units, ["unit_id"], hits, "term").select("term", "unit_id")
