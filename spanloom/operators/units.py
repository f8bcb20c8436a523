"""Blocks to numbered, typed text units. Narrow: one input row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.rows import exploded
from spanloom.functions.rules import classify
from spanloom.functions.sentences import split_sentences


def spread(rows: DataFrame, below: int = 64) -> DataFrame:
    """Rows of a scan with few splits over all cores.

    The text rules need far more time per byte than reading does. Scans of more
    than ``below`` splits are left alone, so large inputs are never shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= min(cores, below) else rows


def blocks_of_lines(lines: Column) -> Column:
    """Plain-text lines as prose blocks."""
    return F.transform(lines, lambda t: F.struct(F.lit("prose").alias("kind"), t.alias("text")))


def merge_lead_ins(blocks: Column) -> Column:
    """Join a prose block that ends in a colon with the list right behind it.

    A list cannot lead in and a joined list is never looked at again, so each
    block needs to see only its two neighbours.
    """
    def at(i: Column) -> Column:
        return F.get(blocks, i)

    def leads(i: Column) -> Column:
        return F.coalesce(
            (at(i)["kind"] == "prose") & (at(i + 1)["kind"] == "list")
            & F.endswith(F.rtrim(at(i)["text"]), F.lit(":")), F.lit(False))

    def joined(b: Column, i: Column) -> Column:
        text = F.when(leads(i), F.concat_ws(" ", F.rtrim(b["text"]), at(i + 1)["text"])
                      ).otherwise(b["text"])
        return F.when(~leads(i - 1), F.struct(b["kind"].alias("kind"), text.alias("text")))

    merged = F.filter(F.transform(blocks, joined), lambda b: b.isNotNull())
    has_list = F.exists(blocks, lambda b: b["kind"] == "list")
    return F.when(has_list, merged).otherwise(blocks)


def sentence_units(blocks: Column) -> Column:
    """Ordered array of (block_seq, block_kind, unit_text) over all blocks."""
    def cut(b: Column, i: Column) -> Column:
        return F.transform(split_sentences(b["text"]), lambda s: F.struct(
            i.cast("int").alias("block_seq"), b["kind"].alias("block_kind"),
            s.alias("unit_text")))
    return F.flatten(F.transform(blocks, cut))


def cut_units(docs: DataFrame, blocks: str = "blocks", keep=("doc_id", "subset")) -> DataFrame:
    """One row per unit with its 1-based ``position``, without its kind.

    The blocks of a document sit in one row, so numbering is the array index.
    """
    cut = exploded(docs, keep, sentence_units(F.col(blocks)), "_u", "_p")
    return cut.select(
        *keep, (F.col("_p") + 1).cast("int").alias("position"), F.col("_u.block_seq"),
        F.col("_u.block_kind"), F.col("_u.unit_text"))


def typed_units(cut: DataFrame, full_urls: bool = False) -> DataFrame:
    """Rows of ``cut_units`` with their kind, fragment type and ``unit_id``."""
    typed = classify(cut, full_urls=full_urls)
    return typed.withColumn("unit_id", F.concat(F.col("doc_id"), F.lit("_U"), F.col("position")))


def units_from_blocks(docs: DataFrame, blocks: str = "blocks", keep=("doc_id", "subset"),
                      full_urls: bool = False) -> DataFrame:
    """One typed row per unit with its 1-based ``position`` and ``unit_id``."""
    return typed_units(cut_units(docs, blocks, keep), full_urls)


def plain_text(docs: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Block texts of each document, one per line."""
    return docs.select("doc_id", F.array_join(
        F.transform(F.col(blocks), lambda b: b["text"]), "\n").alias("text"))
