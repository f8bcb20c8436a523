"""What each filter removes, alone and after others, over all orders of the filters.

Five filters judge a text; a document fails any set of them, which is its mask. All
figures of all orders follow from counts by mask, which add up over any division of
the rows. Four filters read one text. The fifth asks whether a smaller id has the same
text, and finds out in three steps:

1. Every task counts the hashes of its texts in sparse pieces of a counting Bloom
   filter, whose counters stop at two. The pieces are merged segment by segment.
2. A text with a counter below two occurs once for certain, and its row needs no text
   from there on. False alarms only send a few unique texts on.
3. Possible repeats are grouped by hash and full text, equal texts being folded before
   the exchange, for the smallest id. Rows find it by their hash; where different texts
   share a hash, by the text.

The merged filter has 16 counters a row and is broadcast with one bit a counter, so
with 2 bytes a row, up to ``max_bytes``. On tables too large for that more unique
texts pass as possible repeats; results stay the same.

Rows: a null text counts as empty; a null ``part`` is the empty string; a null id
counts as the largest one, and labels never meet it. Rows with the same id are rows of
their own and are no repeats of each other. Several labels of an id count as one that
is good or toxic if any of them is. Other columns are not read. An empty table has no
part and gives no row.
"""

from __future__ import annotations

import json
from itertools import permutations
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.common import NULL_ID, UPPER, staged
from spanloom.llm.countfilter import filter_bits, hits

LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    counted = F.transform(F.array(words), lambda w: F.struct(            # the words once, not twice
        F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    failed = (counted["n"] < 200, 100 * counted["d"] < 50 * counted["n"],
              100 * capitals > 2 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).cast("int")


def _without_unique_texts(bits, text: int, h: int):
    """Texts of rows whose hash meets a counter below two become null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            several = hits(bits.value, batch.column(h).to_numpy(zero_copy_only=False))
            columns = list(batch.columns)
            columns[text] = pa.array([x.as_py() if s else None for x, s in zip(columns[text], several)],
                                     pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)
    return run


# ---- masks and their counts ---------------------------------------------------

def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source",
          max_bytes: int = 1 << 26, text_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, part, mask), one row for each row of ``docs``; no id is ``NULL_ID``."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                      F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                      F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", text_hash(F.col("text")))
    bits = spark.sparkContext.broadcast(filter_bits(own.select("h"), 2, max_bytes))
    judged = own.select("id", "part", "text", "h", own_failures(F.col("text")).alias("mask"))
    rows = staged(judged.mapInArrow(_without_unique_texts(bits, 2, 3),
                                    "id long, part string, text string, h long, mask int"), "judged")
    unique, several = (rows.where(c).select("id", "part", "mask", "h", "text")
                       for c in ("text IS NULL", "text IS NOT NULL"))
    texts = several.groupBy("h", "text").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    groups = texts.groupBy("h").agg(F.count("*").alias("texts"), F.min("first").alias("first"),
                                    F.max("last").alias("last"))
    firsts = staged(groups.where("texts > 1 OR first < last").select("h", "texts", "first"), "firsts")
    found = several.select("id", "part", "mask", "h").join(firsts, "h", "left")
    plain = found.where("texts IS NULL OR texts = 1").select(
        "id", "part", _with_repeats(F.col("first")))
    shared = firsts.where("texts > 1").select("h")
    by_text = several.join(shared, "h", "left_semi").join(
        texts.join(shared, "h", "left_semi").select("h", "text", "first"), ["h", "text"]).select(
        "id", "part", _with_repeats(F.col("first")))
    return unique.select("id", "part", "mask").unionByName(plain).unionByName(by_text)


def _with_repeats(first: Column) -> Column:
    again = F.when(F.col("id") > first, REPEATED).otherwise(0)
    return F.col("mask").bitwiseOR(again).alias("mask")


def mask_counts(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents with a mask, and those of them with a label."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = found.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id")))
    return named.join(marks, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def steps(counts: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step in it, from the counts by mask."""
    plan = [{"filter_order": "".join(o), "step": i + 1, "bit": 1 << LETTERS.index(o[i]),
             "before": sum(1 << LETTERS.index(x) for x in o[:i])}
            for o in permutations(LETTERS) for i in range(len(LETTERS))]
    at = F.from_json(F.lit(json.dumps(plan)),
                     "array<struct<filter_order: string, step: int, bit: int, before: int>>")
    rows = counts.select("*", F.inline(at))
    mask, bit = F.col("mask"), F.col("bit")
    fails, earlier = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier

    def total(when: Column, what: str | Column = "n") -> Column:
        return F.sum(F.when(when, F.col(what) if isinstance(what, str) else what).otherwise(0))
    # of all orders, a filter comes first of the m that a document fails in one of m
    share = F.col("n") * F.lit(120) / F.bit_count(mask)
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"), total(removed).alias("removed"),
        total(fails & earlier).alias("redundant"), total(mask == bit).alias("unique_fails"),
        total(removed, "good").alias("good_lost"), total(removed, "toxic").alias("toxic_lost"),
        total(fails, F.when(mask != 0, share).cast("long")).alias("shapley"))


def interaction(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The audit of ``docs``: ``steps`` of the counts of its masks."""
    return steps(staged(mask_counts(masks(docs, **options), labels), "mask_counts"))
