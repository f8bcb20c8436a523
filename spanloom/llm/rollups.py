"""Token counts as rollups that are maintained by deltas.

A batch holds changes of documents: inserts, deletes, and revisions with new
counts. It is turned into signed totals by source, language and tokenizer
version: what a document counted before is taken off, what it counts now is
added. The batch's deltas and the new entries of the documents are written below
the batch's name, and become part of the rollup when its name is appended to the
commits. A committed batch is not applied again, so batches may be repeated after
a failure. Totals are the sums of all committed deltas.

Rows: a null text has no tokens; null sources and languages are groups of their
own; of several changes of one document and tokenizer in one batch the one with
the largest ``version`` counts, equal ones once; a delete or revision of an unknown
document takes nothing off; rows without an id cannot be revised or deleted, and each
one counts as an insert.
Empty batches are committed and change nothing. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]

#: Token counts by tokenizer version, as expressions of a text.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "pieces-1": r"[A-Za-z0-9]+|[^\x00-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]",
}


def counts(docs: DataFrame, tokenizer: str, version: int = 0, op: str = "upsert") -> DataFrame:
    """Changes that set the counts of ``docs`` (doc_id, source, lang, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.lit(op).alias("op"), F.lit(version).cast("long").alias("version"), "doc_id", "source", "lang",
        F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"),
        F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])).cast("long").alias("n_tokens"),
        F.length(text).cast("long").alias("n_chars"))


def deletes(ids: DataFrame, tokenizer: str, version: int = 0) -> DataFrame:
    """Changes that take the documents ``ids`` (doc_id) out of a tokenizer's counts."""
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    return ids.select(
        F.lit("delete").alias("op"), F.lit(version).cast("long").alias("version"), "doc_id",
        none.alias("source"), none.alias("lang"), F.lit(tokenizer).alias("tokenizer"),
        *[zero.alias(c) for c in SUMS])


class Rollup:
    """Tables below ``folder``: entries and deltas of each batch, and the committed batches.

    Batches are applied in the order of their names.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], "batch string").write.mode("ignore").parquet(f"{folder}/commits")

    def batches(self) -> list[str]:
        """Names of the committed batches, in order."""
        return sorted({r[0] for r in self.spark.read.schema("batch string")
                       .parquet(f"{self.folder}/commits").collect()})

    def _read(self, part: str) -> DataFrame | None:
        paths = [f"{self.folder}/{part}/{b}" for b in self.batches()]
        return self.spark.read.parquet(*paths) if paths else None

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before, and then nothing changes.

        A batch that failed before its commit is written anew when it is repeated.
        """
        done = self.batches()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after {done[-1]} was committed")
        values = ["source", "lang", *SUMS]
        last = changes.where("doc_id IS NOT NULL").groupBy("doc_id", "tokenizer").agg(
            F.max(F.struct("version", "op", *values)).alias("x"))
        entries, deltas = f"{self.folder}/entries/{batch}", f"{self.folder}/deltas/{batch}"
        last.select("doc_id", "tokenizer", "x.op", *[f"x.{c}" for c in values],
                    F.lit(batch).alias("batch")).write.mode("overwrite").parquet(entries)
        now = self.spark.read.parquet(entries)
        nameless = changes.where("doc_id IS NULL AND op <> 'delete'")
        signed = now.where("op <> 'delete'").select(*KEYS, *SUMS).unionByName(nameless.select(*KEYS, *SUMS))
        before = self.current()
        if before is not None:
            gone = before.join(now.select("doc_id", "tokenizer"), ["doc_id", "tokenizer"], "left_semi")
            signed = signed.unionByName(gone.select(*KEYS, *[(-F.col(c)).alias(c) for c in SUMS]))
        signed.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).write.mode(
            "overwrite").parquet(deltas)
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode(
            "append").parquet(f"{self.folder}/commits")
        return True

    def current(self) -> DataFrame | None:
        """What each document counts by now; None before the first batch."""
        rows = self._read("entries")
        if rows is None:
            return None
        latest = rows.groupBy("doc_id", "tokenizer").agg(F.max("batch").alias("batch"))
        return rows.join(latest, ["doc_id", "tokenizer", "batch"]).where("op <> 'delete'")

    def totals(self) -> DataFrame:
        """Sums of the committed deltas; groups that are empty by now are left out."""
        rows = self._read("deltas")
        if rows is None:
            raise ValueError("no batch has been committed")
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0")
