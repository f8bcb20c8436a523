"""Line dedup: lines that several documents share stay in one of them only.

Lines are normalised and hashed, each document giving every hash once; per hash the
documents are counted, and lines over the threshold are dropped from all of them but
the smallest. Ids that several rows share are looked up first, so that only their rows
have to be made distinct. Hashes of dropped lines are gathered per document, and the documents that have any are
rebuilt by position. Only hashes and ids are shuffled for the count; hashes of
128 bits stand for the lines.

Rows: a null or empty text is one empty line; rows with the same id are one
document, and so are rows without an id, which counts as the largest one. Other
columns stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spanloom.llm.common import NULL_ID, staged


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line without spaces around it and with a-z for A-Z; None if it is short."""
    key = line.strip().lower()
    n = len(key)
    if n < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = (text.as_py() or "").encode().split(b"\n")
                own = {h for x in lines if (h := line_hash(x, min_chars)) is not None}
                ids += [doc] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.binary()), pa.array(ids, pa.int64())], ["h", "d"])
    return run


def _rebuilt(min_chars: int, names: list[str], text: int):
    """The last column holds the hashes to drop, or null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for x, drop in zip(batch.column(text), batch.column(batch.num_columns - 1)):
                raw = (x.as_py() or "").encode().split(b"\n")
                gone = set(drop.as_py() or ())
                kept = [y for y in raw if line_hash(y, min_chars) not in gone] if gone else raw
                texts.append(b"\n".join(kept).decode())
                lines.append(len(raw))
                dropped.append(len(raw) - len(kept))
            columns = batch.columns[:-1]
            columns[text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names + ["n_lines", "n_dropped"])
    return run


def dropped_hashes(docs: DataFrame, min_chars: int = 10, doc_id: str = "doc_id",
                   text: str = "text", min_docs: int = 2) -> DataFrame:
    """(d, gone): per document the hashes of the lines it loses; d is never null."""
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    lines = staged(docs.select(own, F.col(text)).mapInArrow(
        _hashes(min_chars), "h binary, d long"), "lines")
    repeated = staged(docs.groupBy(own.alias("d")).agg(F.count("*").alias("n")).where("n > 1")
                      .select("d"), "repeated_ids")
    once = lines.join(repeated, "d", "left_anti").select("h", "d").unionByName(
        lines.join(repeated, "d", "left_semi").select("h", "d").distinct())
    shared = staged(once.groupBy("h").agg(F.min("d").alias("first"), F.count("*").alias("n_docs"))
                    .where(F.col("n_docs") >= min_docs).select("h", "first"), "shared")
    return lines.join(shared, "h").where("d > first").groupBy("d").agg(
        F.collect_set("h").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, doc_id: str = "doc_id",
                text: str = "text", min_docs: int = 2) -> DataFrame:
    """``docs`` with the lines left in ``text``, and n_lines (before) and n_dropped.

    A line of at least ``min_chars`` code points that ``min_docs`` or more documents hold
    stays in the document with the smallest id. Columns of ``docs`` that are named
    n_lines or n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    gone = staged(dropped_hashes(docs, min_chars, doc_id, text, min_docs), "gone")
    own = F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID))
    joined = docs.join(gone, own == gone["d"], "left").select(*[docs[c] for c in docs.columns],
                                                              gone["gone"].alias("_gone"))
    schema = StructType([StructField(f.name, StringType()) if f.name == text else f
                         for f in docs.schema.fields]
                        + [StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    return joined.mapInArrow(_rebuilt(min_chars, docs.columns, docs.columns.index(text)), schema)
