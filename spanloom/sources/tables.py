"""Canonical inputs derived from plain Parquet tables of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.functions.rows import exploded
from spanloom.functions.sentences import block_lines
from spanloom.functions.text import words
from spanloom.operators.units import blocks_of_lines
from spanloom.schema import LABELS
from spanloom.session import configure


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session gets the settings that the operators are written for."""
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def document_id() -> Column:
    """Id of a plain-text document."""
    return F.concat_ws("_", "lang", "doc_id")


def document_blocks(docs: DataFrame) -> DataFrame:
    """Plain-text documents (doc_id, text, lang, source) with their lines as blocks."""
    lines = block_lines(F.col("text"))
    return docs.select(
        document_id().alias("doc_id"), F.col("lang").alias("subset"),
        F.col("doc_id").cast("int").alias("num"),
        F.concat_ws("/", "source", "doc_id").alias("link"),
        blocks_of_lines(lines).alias("blocks"))


def document_rows(blocks: DataFrame) -> DataFrame:
    """``documents`` rows; the title is the first line."""
    none = F.lit(None).cast("string")
    return blocks.select(
        "doc_id", "subset", "num", F.get("blocks", F.lit(0))["text"].alias("title"), "link",
        *[none.alias(c) for c in ("is_homepage", "textmatch_p", "textmatch_s",
                                  "textmatch_pp", "link_match")],
        F.lit("documents.parquet").alias("html_path"), none.alias("crawl_path"))


def derived_spans(blocks: DataFrame, copies: int = 3) -> DataFrame:
    """Annotator spans cut from every line, ``copies`` annotators each.

    By (num + line) mod 5 a span is a phrase of the line, the whole line, every
    other word of it, noise, or the word "the".
    """
    lines = exploded(blocks, ["doc_id", "num"], F.col("blocks"), "b", "k").select(
        "doc_id", F.col("num").cast("long").alias("num"), F.col("k").cast("long").alias("k"),
        F.col("b.text").alias("line"))
    w = words(F.col("line"))
    num, k, j = F.col("num"), F.col("k"), F.col("j")

    def md5_of(a: Column, b: Column) -> Column:
        return F.md5(F.concat_ws("-", a, b).cast("binary"))

    kind = (num + k) % 5
    text = (F.when(kind == 0, F.array_join(F.slice(w, 2, 8), " "))
            .when(kind == 1, F.col("line"))
            .when(kind == 2, F.array_join(F.filter(w, lambda _, i: i % 2 == 0), " "))
            .when(kind == 3, F.concat_ws(" ", md5_of(num, k), md5_of(k, num)))
            .otherwise("the"))
    rows = lines.select("doc_id", "num", "k", text.alias("text")).where("text <> ''").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("j"))     # texts once for all copies
    label = F.get(F.array(*[F.lit(x) for x in LABELS]), ((num + j * (k % 2)) % 13).cast("int"))
    src_row = (k * copies + j).cast("int")
    return rows.select(
        F.concat(F.col("doc_id"), F.lit("_A"), src_row).alias("annotation_id"), "doc_id",
        F.concat(F.lit("ra"), 1 + (num + k + j) % 6).alias("ranumb"), "text",
        label.alias("label"), src_row.alias("src_row"),
        F.lit("documents.parquet").alias("source_csv"))
