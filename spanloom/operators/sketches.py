"""Distinct-text counts from stored sketches.

For each (subset, unit kind, label category) a table keeps the number of units and a theta
sketch of their texts. Counts of any union of these cells, and of the texts of one union
that another one lacks, follow from the table alone, and tables of disjoint corpora merge
without reading their units. Up to 2^lg different texts of a cell are counted exactly;
beyond that the relative standard error of a union is about 2^(-lg/2), 1.6 % for lg = 12.
The error of a difference is that share of the union of both sides. Where the units are at
hand, ``counts`` counts in them what the sketches can only estimate. The exact counts of
``stats`` stay the default.

Null texts are not counted; null subsets are a group of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.text import text_key

CELL = ["subset", "unit_kind", "label_category"]
LG = 12


@dataclass
class TextSketches:
    cells: DataFrame        # subset, unit_kind, label_category, units, texts
    lg: int = LG

    @staticmethod
    def build(units: DataFrame, path: str, lg: int = LG) -> "TextSketches":
        """Sketches of ``units`` (the cell's columns and unit_text), written to ``path``."""
        units.groupBy(*CELL).agg(
            F.count("*").alias("units"), F.theta_sketch_agg("unit_text", lg).alias("texts")) \
            .write.mode("error").parquet(path)
        return TextSketches(units.sparkSession.read.parquet(path), lg)

    def merged(self, other: "TextSketches") -> "TextSketches":
        """Sketches of both corpora together, of the smaller size of the two."""
        lg = min(self.lg, other.lg)
        both = self.cells.unionByName(other.cells).groupBy(*CELL).agg(
            F.sum("units").alias("units"), F.theta_union_agg("texts", lg).alias("texts"))
        return TextSketches(both, lg)

    def texts(self, where: Column) -> Column:
        """Aggregate: the sketch of the texts of all cells that meet ``where``."""
        return F.theta_union_agg(F.when(where, F.col("texts")), self.lg)

    def unique(self, where: Column) -> Column:
        """Aggregate: different texts of the cells that meet ``where``."""
        return F.theta_sketch_estimate(self.texts(where))

    def unique_without(self, where: Column, other: Column) -> Column:
        """Aggregate: different texts of the cells of ``where`` that no cell of ``other`` has."""
        return F.theta_sketch_estimate(F.theta_difference(self.texts(where), self.texts(other)))

    def counts(self, *by: str, units: DataFrame | None = None) -> DataFrame:
        """Units and different texts, for each value of the columns ``by``.

        With ``units`` all counts are exact: values with 2^lg texts or more, which the
        sketches estimate, are counted there. Only the units of such values are read twice.
        """
        category = F.col("label_category")
        defined = category.isin("single_label", "multi_label")
        found = self.cells.groupBy(*by).agg(
            F.sum("units").alias("units"),
            self.unique(F.col("unit_kind") == "sentence").alias("unique_sentences"),
            self.unique(F.col("unit_kind") == "fragment").alias("unique_fragments"),
            self.unique(defined).alias("unique_defined_samples"),
            self.unique_without(defined, category == "unlabeled").alias("never_unlabeled"),
            self.unique(F.lit(True)).alias("_most"))
        if units is None:
            return found.drop("_most")
        exact = F.col("_most") < (1 << self.lg)           # an estimate is never below
        beyond = found.where(~exact).select(*by, F.lit(True).alias("_beyond"))
        if beyond.isEmpty():
            return found.drop("_most")
        own = reduce(Column.__and__, [units[c].eqNullSafe(beyond[c]) for c in by], F.lit(True))
        return found.where(exact).drop("_most").unionByName(
            _exact_counts(units.join(beyond, own, "left_semi"), *by))


def _exact_counts(units: DataFrame, *by: str) -> DataFrame:
    """The columns of ``TextSketches.counts``, from texts folded by value."""
    def some(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition & F.col("unit_text").isNotNull()), F.lit(False))
    category = F.col("label_category")
    texts = units.groupBy(*by, *text_key(F.col("unit_text"))).agg(
        F.count("*").alias("n"), some(F.col("unit_kind") == "sentence").alias("_sentence"),
        some(F.col("unit_kind") == "fragment").alias("_fragment"),
        some(category.isin("single_label", "multi_label")).alias("_defined"),
        some(category == "unlabeled").alias("_loose"))
    return texts.groupBy(*by).agg(
        F.sum("n").alias("units"), F.count_if("_sentence").alias("unique_sentences"),
        F.count_if("_fragment").alias("unique_fragments"),
        F.count_if("_defined").alias("unique_defined_samples"),
        F.count_if(F.col("_defined") & ~F.col("_loose")).alias("never_unlabeled"))
