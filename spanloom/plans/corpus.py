"""Corpus build: documents and spans in, eight durable tables out."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass, fields
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom import schema
from spanloom.operators import evidence
from spanloom.operators.align import align, with_norms
from spanloom.operators.paging import page_index
from spanloom.operators.units import units_from_blocks
from spanloom.session import (forget, read_buckets, remove, shared_dir, write_and_read, write_buckets,
                              write_table)


@dataclass
class Corpus:
    documents: DataFrame
    annotations: DataFrame
    text_units: DataFrame
    unit_labels: DataFrame
    alignment: DataFrame
    ambiguous: DataFrame
    ladder: DataFrame               # votes per unit and label, for any threshold
    page_index: DataFrame           # rows before each document

    text_index = None               # a ``TextIndex`` of the units, where one was built
    folder = None                   # where the tables of this version are
    buckets = None                  # into how many these are dealt out by document

    def register(self) -> "Corpus":
        """Expose every table as a view for ``spark.sql``."""
        for f in fields(self):
            getattr(self, f.name).createOrReplaceTempView(f.name)
        return self

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "Corpus":
        """Tables of the last version that was built completely."""
        last = spark.read.parquet(f"{folder}/versions").orderBy(F.desc("built_at"), "version").first()
        spark.conf.set(*CO_PARTITION)

        def table(name: str) -> DataFrame:
            path, (order, partition) = f"{folder}/{last['version']}/{name}", LAYOUT[name]
            if not last["buckets"] or name in UNBUCKETED:
                return spark.read.parquet(path)
            return read_buckets(spark, path, "doc_id", order, last["buckets"], partition)
        corpus = Corpus(*[table(f.name) for f in fields(Corpus)])
        corpus.folder, corpus.buckets = f"{folder}/{last['version']}", last["buckets"]
        return corpus


#: Folders and sort order of the tables: conditions on them prune a scan.
LAYOUT = {
    "documents": (["doc_id"], "subset"), "annotations": (["doc_id", "src_row"], None),
    "text_units": (["doc_id", "position"], "subset"), "unit_labels": (["doc_id", "unit_id"], None),
    "alignment": (["doc_id", "unit_id"], None), "ambiguous": (["doc_id", "span_rep"], None),
    "ladder": (["doc_id", "unit_id"], None), "page_index": (["doc_id"], None),
}
#: In ranges of documents, so that a condition on the rows before leaves out files.
UNBUCKETED = ("page_index",)
#: Tables hashed by document also join by document and more columns as they are.
CO_PARTITION = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
#: A scan by splits would write a file for each split and bucket, a scan by buckets one for each bucket.
BY_SPLITS = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
#: Groups of lists and sets that a task hashes before it sorts all its rows instead: 128 by default.
GROUPS, MANY_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(1 << 16)


def build(documents: DataFrame, blocks: DataFrame, spans: DataFrame,
          folder: str | None = None, full_urls: bool = False, buckets: int | None = None) -> Corpus:
    """Full rebuild of all tables below ``folder`` (default: a new one in the shared folder).

    ``documents`` has the document columns, ``blocks`` doc_id, subset and the
    ``blocks`` array, ``spans`` the annotation columns without a status. Tables are
    written below a new version, which counts once all of them are there; what was
    written in between is removed.

    Units and spans are dealt out by document once, into ``buckets`` (default: the
    session's shuffle partitions). All tables but the page index are kept that way, and
    no join of theirs by document needs an exchange. With ``buckets=0`` tables are
    plain: for corpora in which one document has a large share of all spans, because
    joins then shuffle and adaptive execution splits what is skewed.

    Nothing of a table passes the driver: joins of tables in the same buckets need no
    broadcast, so none is made while the tables are built.
    """
    with by_buckets(documents.sparkSession):
        return _build(documents, blocks, spans, folder, full_urls, buckets)


@contextmanager
def by_buckets(spark: SparkSession) -> Iterator[None]:
    """Settings under which tables in the same buckets are read a task a bucket, and none is broadcast."""
    spark.conf.set(*CO_PARTITION)
    before = {key: spark.conf.get(key) for key in (BROADCAST, BY_SPLITS, GROUPS)}
    spark.conf.set(BROADCAST, "-1")
    spark.conf.set(BY_SPLITS, "false")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _build(documents: DataFrame, blocks: DataFrame, spans: DataFrame,
           folder: str | None, full_urls: bool, buckets: int | None) -> Corpus:
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) if buckets is None else buckets
    version = f"version-{uuid.uuid4().hex}"
    folder = folder or f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    work = f"{folder}/work-{version}"
    between: list[str] = []

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(buckets, "doc_id") if buckets else df

    def keep(df: DataFrame, name: str) -> DataFrame:
        if not buckets:
            return write_and_read(df, name, work)
        between.append(f"{work}/{name}")
        return write_buckets(df, between[-1], "doc_id", ["doc_id"], buckets)

    def table(name: str, df: DataFrame) -> DataFrame:
        path, (order, partition) = f"{folder}/{version}/{name}", LAYOUT[name]
        if not buckets or name in UNBUCKETED:
            return write_table(df, path, order, partition)
        return write_buckets(df, path, "doc_id", order, buckets, partition)

    # documents are dealt out before they are cut: whole ones are fewer rows and bytes
    units = with_norms(units_from_blocks(dealt(blocks), full_urls=full_urls), "unit_text", keep, "units")
    result = align(units, dealt(spans), keep, buckets or None, lambda: spark.conf.set(GROUPS, MANY_GROUPS))
    documents = documents.select(*schema.DOCUMENTS.fieldNames())

    alignment = table("alignment", result.alignment)
    annotations = table("annotations", result.spans.select(*schema.ANNOTATIONS.fieldNames()))
    text_units = table("text_units", evidence.label_units(units, alignment))
    corpus = Corpus(
        table("documents", dealt(documents)), annotations, text_units,
        table("unit_labels", evidence.unit_labels(text_units)), alignment,
        table("ambiguous", result.ambiguous),
        table("ladder", evidence.vote_ladder(evidence.votes(alignment), evidence.annotator_pool(annotations))),
        table("page_index", page_index(documents, text_units, annotations, work)))
    corpus.folder, corpus.buckets = f"{folder}/{version}", buckets
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("built_at"),
                          F.lit(buckets).alias("buckets")) \
        .coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    for path in between:
        forget(spark, path)
    remove(spark, work)
    return corpus


def unaligned(units: DataFrame, spans: DataFrame | None = None) -> Corpus:
    """A corpus of ``units`` and ``spans`` alone, as they are before any alignment."""
    corpus = Corpus(**{f.name: empty_units(units) if f.name == "text_units" else None for f in fields(Corpus)})
    if spans is not None:
        corpus.annotations = spans.withColumns({"status": F.lit(None).cast("string"), "n_hits": F.lit(None).cast("long")})
    return corpus


def empty_units(units: DataFrame) -> DataFrame:
    """Units before any alignment: sentences unlabeled, fragments not eligible."""
    none = F.array().cast("array<string>")
    return units.withColumns({
        "label_category": evidence.label_category(F.col("unit_kind"), none),
        "annotator_count": F.lit(0), "source_annotation_count": F.lit(0),
        "alignment_types": F.lit(None).cast("string"), "labels": none, "annotators": none})
