"""Pages of rows in document order that read the documents of the page only.

The page index has, for each document in order, how many units and spans stand before
it. A page of all rows is located in the index alone. A page of filtered rows first
counts them by ranges of documents, at most ``RANGES`` of them; then only the range or
ranges that hold the page are read and sorted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.operators.prefix import running_total
from spanloom.session import write_and_read

RANGES = 4096
#: Up to so many documents of a page are named one by one, which leaves out buckets too.
NAMED = 100


def page_index(documents: DataFrame, units: DataFrame, spans: DataFrame, folder: str) -> DataFrame:
    """(doc_id, doc_no, n_units, units_before, n_spans, spans_before), sorted by document."""
    def per_document(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("doc_id").agg(F.count("*").alias(name))
    sizes = (documents.select("doc_id").distinct().join(per_document(units, "n_units"), "doc_id", "left")
             .join(per_document(spans, "n_spans"), "doc_id", "left").fillna(0, ["n_units", "n_spans"]))
    ordered = write_and_read(sizes.repartitionByRange("doc_id").withColumn("_range", F.spark_partition_id()),
                             "document_sizes", folder)
    found = ordered.withColumn("_one", F.lit(1).cast("long"))
    for amount, name in (("_one", "doc_no"), ("n_units", "units_before"), ("n_spans", "spans_before")):
        found = running_total(found, [], F.col("_range"), ["doc_id"], F.col(amount), name, inclusive=False)
    return found.select("doc_id", "doc_no", "n_units", "units_before", "n_spans", "spans_before")


def _documents(ids: list[str]) -> Column:
    return F.col("doc_id").isin(*ids) if len(ids) <= NAMED else F.col("doc_id").between(min(ids), max(ids))


def locate_all(index: DataFrame, what: str, offset: int, limit: int) -> tuple[Column, int]:
    """Condition on the documents that hold a page of all ``what`` (units or spans), and
    the number of their rows that stand before the page."""
    n, before = F.col(f"n_{what}"), F.col(f"{what}_before")
    held = index.where((n > 0) & (before < offset + limit) & (before + n > offset)).select(
        "doc_id", before.alias("before")).orderBy("before").collect()      # at most ``limit``
    if not held:
        return F.lit(False), 0
    return _documents([r["doc_id"] for r in held]), offset - held[0]["before"]


def locate(index: DataFrame, rows: DataFrame, offset: int, limit: int) -> tuple[Column, int]:
    """As ``locate_all``, for the rows (doc_id, …) that a filter leaves."""
    last = index.agg(F.max("doc_no")).first()[0]
    if last is None:
        return F.lit(False), 0
    width = last // RANGES + 1
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(
        index.select("doc_id", "doc_no"), "doc_id").groupBy(F.floor(F.col("doc_no") / width).alias("r")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    conditions, before, skip = [], 0, None
    for r in counts.orderBy("r").collect():                                # at most RANGES
        if before < offset + limit and before + r["n"] > offset:
            skip = offset - before if skip is None else skip
            conditions.append(F.col("doc_id").between(r["low"], r["high"]))
        before += r["n"]
    return (reduce(lambda a, b: a | b, conditions), skip) if conditions else (F.lit(False), 0)
