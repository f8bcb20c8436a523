"""Evidence, votes and agreement tiers of text units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unit_evidence(alignment: DataFrame) -> DataFrame:
    """Labels, annotators, match types and span count per unit.

    Labels, counts and types are kept for sentences only; annotators for all
    units, fragments included.
    """
    sentence = F.col("unit_kind") == "sentence"

    def distinct(c: str, only: Column | None = None) -> Column:
        return F.array_sort(F.collect_set(F.when(only, F.col(c)) if only is not None else F.col(c)))

    return alignment.groupBy("doc_id", "unit_id").agg(
        distinct("label", sentence).alias("labels"),
        distinct("ranumb").alias("annotators"),
        distinct("alignment_type", sentence).alias("types"),
        F.count_if(sentence).alias("n_spans"))


def label_category(unit_kind: Column, labels: Column) -> Column:
    n = F.coalesce(F.size(labels), F.lit(0))
    return (F.when(unit_kind != "sentence", "not-eligible")
            .when(n <= 0, "unlabeled").when(n == 1, "single_label").otherwise("multi_label"))


def label_units(units: DataFrame, alignment: DataFrame) -> DataFrame:
    """Final unit rows: category, counts and match types by one left join."""
    e = unit_evidence(alignment)
    empty = F.array().cast("array<string>")
    sentence = F.col("unit_kind") == "sentence"
    types = F.array_join("types", ";")
    return (units.join(e, ["doc_id", "unit_id"], "left")
            .withColumns({"labels": F.coalesce("labels", empty),
                          "annotators": F.coalesce("annotators", empty)})
            .withColumns({
                "label_category": label_category(F.col("unit_kind"), F.col("labels")),
                "annotator_count": F.when(sentence, F.size("annotators")).otherwise(0),
                "source_annotation_count":
                    F.when(sentence, F.coalesce("n_spans", F.lit(0))).otherwise(0).cast("int"),
                "alignment_types": F.when(types != "", types)})
            .select("unit_id", "doc_id", "subset", "position", "block_seq", "block_kind",
                    "unit_text", "unit_kind", "fragment_type", "label_category",
                    "annotator_count", "source_annotation_count", "alignment_types",
                    "labels", "annotators"))


def unit_labels(text_units: DataFrame) -> DataFrame:
    return text_units.select("unit_id", F.explode("labels").alias("label"), "doc_id")


def annotator_pool(annotations: DataFrame) -> DataFrame:
    """Distinct annotators per document, whatever became of their spans."""
    return annotations.groupBy("doc_id").agg(F.count_distinct("ranumb").alias("pool"))


def votes(alignment: DataFrame) -> DataFrame:
    """Aligned spans that carry one of their unit's labels: those of sentences."""
    return alignment.where("unit_kind = 'sentence'").select("unit_id", "doc_id", "label", "ranumb")


def tier(k: Column, pool: Column) -> Column:
    """3 unanimous, 2 at least half, 1 fewer."""
    return F.when(k == pool, 3).when(k * 2 >= pool, 2).otherwise(1)


def vote_ladder(vote_rows: DataFrame, pool: DataFrame) -> DataFrame:
    """Per (unit, label) the span counts of its annotators, largest first, and the pool.

    The support at any threshold t follows from it: as many annotators as entries >= t.
    """
    per_annotator = vote_rows.groupBy("doc_id", "unit_id", "label", "ranumb").agg(F.count("*").alias("c"))
    ladder = per_annotator.groupBy("doc_id", "unit_id", "label").agg(
        F.sort_array(F.collect_list("c"), asc=False).alias("steps"))     # at most the pool
    return ladder.join(pool, "doc_id").select("unit_id", "doc_id", "label", "steps", "pool")


def support_at(ladder: DataFrame, threshold: int | None = 1) -> DataFrame:
    """Annotators behind each (unit, label): k, pool and agreement stars.

    An annotator counts with at least ``threshold`` aligned spans for the pair.
    """
    t = int(threshold or 1)
    k = F.size(F.filter("steps", lambda c: c >= t)).cast("long")
    found = ladder if t == 1 else ladder.where(F.get("steps", F.lit(0)) >= t)
    return found.select("doc_id", "unit_id", "label", k.alias("k"), "pool",
                        tier(k, F.col("pool")).alias("stars"))


def unit_support(vote_rows: DataFrame, pool: DataFrame, threshold: int | None = 1) -> DataFrame:
    """The support at one threshold, counted from votes."""
    return support_at(vote_ladder(vote_rows, pool), threshold)


def support_gate(support: DataFrame, min_support: int | None = 1,
                 mode: str | None = "at_least") -> DataFrame:
    """Unit ids whose best label meets the tier (all others: at least one vote)."""
    level = int(min_support or 1)
    level = level if level in (1, 2, 3) else 1
    best = support.groupBy("doc_id", "unit_id").agg(F.max("k").alias("mk"), F.max("pool").alias("pool"))
    stars = tier(F.col("mk"), F.col("pool"))
    return best.where(stars == level if mode == "exact" else stars >= level).select("unit_id", "doc_id")


def support_by_unit(support: DataFrame) -> DataFrame:
    """Support pairs of a unit as one array, with the best stars and vote count."""
    pair = F.struct("label", "k", "pool", "stars")
    return support.groupBy("doc_id", "unit_id").agg(
        F.array_sort(F.collect_list(pair)).alias("support"),
        F.max("stars").alias("support_stars"), F.max("k").alias("support_evidence"))
