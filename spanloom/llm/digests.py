"""Exact dedup with a persistent index of digests, bucketed and sorted by digest.

A batch is reduced to digests; equal texts are folded before any join. Digests
that the index lacks are found by a sort-merge anti-join and appended. The index
side of that join is read bucket by bucket and is not shuffled. Texts are hashed
where they are read and never moved.

The index is a folder: ``data`` with the files of each attempt at a batch, which have
their bucket in their names, ``made`` with the number of buckets, and ``commits`` with
the batches that count. It is opened by its path in any session, whatever that has in
its catalog. A batch that failed before its commit left files that nothing reads. One
that is repeated after its commit changes nothing and gets the answer that it got, or
would have got, the first time. Batches are ingested one at a time.

Rows: a null text counts as empty; a null id counts below all others; of
repeated rows with the same id and text one stays; columns named ``carry`` are
kept as they are. An empty batch leaves the index as it is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from spanloom.llm.common import staged
from spanloom.session import make_folder, read_buckets, table_name

INDEX = StructType([StructField("digest", BinaryType()), StructField("keep_id", LongType()),
                    StructField("attempt", StringType())])
COMMIT = "batch string, attempt string, number int"
NO_ID = -(1 << 63)


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class DigestIndex:
    """The digests (digest, keep_id) of all texts in the committed batches below ``path``.

    The number of buckets is fixed when the index is made: the session's number of
    shuffle partitions, if none is given then.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        made = spark.createDataFrame([(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")),)], "buckets int")
        made.coalesce(1).write.mode("ignore").parquet(f"{path}/made")
        spark.createDataFrame([], COMMIT).write.mode("ignore").parquet(f"{path}/commits")
        make_folder(spark, f"{path}/data")
        self.buckets = spark.read.parquet(f"{path}/made").first()["buckets"]

    def commits(self) -> dict[str, tuple[int, str]]:
        """The number and the attempt of each committed batch."""
        rows = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits").collect()
        return {r["batch"]: (r["number"], r["attempt"]) for r in rows}

    def table(self, before: int | None = None) -> DataFrame:
        """(digest, keep_id) of the batches committed, or of those with a number below ``before``."""
        files = read_buckets(self.spark, f"{self.path}/data", "digest", ["digest"], self.buckets, "attempt", INDEX)
        counts = [a for n, a in self.commits().values() if before is None or n < before]
        return files.where(F.col("attempt").isin(counts) if counts else F.lit(False)).select("digest", "keep_id")

    def ingest(self, docs: DataFrame, batch: str | None = None, doc_id: str = "doc_id", text: str = "text",
               carry: tuple[str, ...] = ()) -> DataFrame:
        """Judge and append a batch: one row for each row of ``docs``.

        (doc_id, *carry, digest, keep_id, group_size, kept): of equal texts of the
        batch the one with the largest id stays, unless an earlier batch had the
        text; ``group_size`` counts the rows of the batch with the text. Columns to
        carry with the name of one of these are left out.
        """
        commits = self.commits()
        batch = batch or uuid.uuid4().hex
        number = commits[batch][0] if batch in commits else len(commits)
        own = [doc_id, "digest", "keep_id", "group_size", "kept"]
        carry = tuple(c for c in carry if c not in own)
        rows = staged(docs.select(
            F.col(doc_id).cast("long").alias(doc_id), *carry, digest(F.col(text)).alias("digest"),
            F.monotonically_increasing_id().alias("_row")), "digests")
        groups = staged(
            rows.groupBy("digest", F.coalesce(F.col(doc_id), F.lit(NO_ID)).alias("_id")).agg(
                F.max("_row").alias("_row"), F.count("*").alias("n"))
            .groupBy("digest").agg(F.max("_id").alias("_id"), F.max_by("_row", "_id").alias("_first"),
                                   F.sum("n").alias("group_size")), "groups")
        old = self.table(number)
        if batch not in commits:
            fresh = groups.join(old.select("digest").hint("merge"), "digest", "left_anti")
            attempt = f"{number}-{uuid.uuid4().hex}"
            fresh.select("digest", F.col("_id").alias("keep_id"), F.lit(attempt).alias("attempt")).repartition(
                self.buckets, "digest").write.insertInto(table_name(f"{self.path}/data"))
            self.spark.createDataFrame([(batch, attempt, number)], COMMIT).coalesce(1).write.mode(
                "append").parquet(f"{self.path}/commits")
        known = old.withColumnRenamed("keep_id", "_old").hint("merge")
        judged = staged(groups.join(known, "digest", "left").select(
            "digest", F.coalesce("_old", "_id").alias("_keep"), "group_size",
            F.when(F.col("_old").isNull(), F.col("_first")).alias("_first")), "judged")
        return rows.join(judged, "digest").select(
            doc_id, *carry, "digest", F.when(F.col("_keep") != NO_ID, F.col("_keep")).alias("keep_id"), "group_size",
            F.col("_row").eqNullSafe(F.col("_first")).alias("kept"))
