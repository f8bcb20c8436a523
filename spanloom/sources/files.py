"""Readers of a corpus folder: Htmls/, Annotations/ and Crawl/ per subset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.functions.text import normalize, strip
from spanloom.sources import csvranges

# --- fixed values: source columns -------------------------------------------
SPAN_COLUMNS = {"RANumb": "ranumb", "Text": "text", "Label": "label"}
CRAWL_COLUMNS = {"Link": "link", "IsHomepage": "is_homepage", "Textmatch_P": "textmatch_p",
                 "Textmatch_S": "textmatch_s", "Textmatch_PP": "textmatch_pp",
                 "Link_Match": "link_match"}
# --- end of fixed values ----------------------------------------------------


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Path and text of each file; invalid bytes become replacement characters."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(folder)
            .select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")))


def _named(files: DataFrame) -> DataFrame:
    """Subset folder and document number from ``…/{subset}/{num}.ext``."""
    part = F.regexp_extract("path", r"([^/]+)/(\d+)\.[a-z]+$", 1)
    num = F.regexp_extract("path", r"([^/]+)/(\d+)\.[a-z]+$", 2)
    return files.withColumns({"subset": part, "_num": num}).where("_num <> ''").withColumn(
        "num", F.col("_num").cast("int")).drop("_num")


def read_html(spark: SparkSession, root: str) -> DataFrame:
    """Pages: subset, num, html, html_path."""
    return _named(_files(spark, f"{root}/Htmls", "*.html")).select(
        "subset", "num", F.col("content").alias("html"), F.col("path").alias("html_path"))


def read_span_rows(spark: SparkSession, root: str) -> DataFrame:
    """All rows of the annotation files, unfiltered."""
    return _named(csvranges.rows(spark, f"{root}/Annotations", r"\.csv$", SPAN_COLUMNS))


def usable_spans(rows: DataFrame) -> DataFrame:
    """Spans with a label and a text that is not empty once normalised."""
    label = strip(F.col("label"))
    doc_id = F.concat_ws("_", "subset", "num")
    return (rows.where((F.col("text") != "") & (label != "") & (normalize(F.col("text")) != ""))
            .select(F.concat(doc_id, F.lit("_A"), F.col("row")).alias("annotation_id"),
                    doc_id.alias("doc_id"), strip(F.col("ranumb")).alias("ranumb"), "text",
                    label.alias("label"), F.col("row").alias("src_row"),
                    F.col("path").alias("source_csv")))


def read_crawl(spark: SparkSession, root: str, subsets=("DB", "WS")) -> DataFrame:
    """Crawl rows; data row i describes document number i + 1 of its subset."""
    rows = csvranges.rows(spark, f"{root}/Crawl", r"\.csv$", CRAWL_COLUMNS)
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    subset = F.lit(None).cast("string")
    for s in subsets:
        subset = F.when(F.contains(name, F.lit(s.lower())), s).otherwise(subset)
    return rows.withColumn("subset", subset).where("subset is not null").select("subset", (F.col("row") + 1).alias("num"),
                       *[strip(F.col(c)).alias(c) for c in CRAWL_COLUMNS.values()],
                       F.col("path").alias("crawl_path"))


def read_pages(spark: SparkSession, root: str, max_docs: int | None = None,
               subsets=("DB", "WS")) -> DataFrame:
    """Pages that have an annotation file, with their crawl columns when known.

    ``max_docs`` keeps the first documents by subset and span file path.
    """
    pairs = (_named(_files(spark, f"{root}/Annotations", "*.csv").select("path"))
             .where(F.col("subset").isin(*subsets)).withColumnRenamed("path", "source_csv"))
    if max_docs:
        pairs = pairs.orderBy("subset", "source_csv").limit(max_docs)
    return (read_html(spark, root).join(pairs, ["subset", "num"])
            .join(read_crawl(spark, root, subsets), ["subset", "num"], "left")
            .withColumn("doc_id", F.concat_ws("_", "subset", "num")))
