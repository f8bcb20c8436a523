"""Counts, build manifest, fingerprints and corpus slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.operators import stats
from spanloom.plans.corpus import Corpus
from spanloom.session import read_footers, write_and_read

TABLES = ("alignment", "ambiguous", "annotations", "documents", "text_units", "unit_labels")


def row_counts(corpus: Corpus) -> DataFrame:
    """Rows of every table; of a written corpus by the footers of its files alone."""
    def rows(table: str) -> DataFrame:
        df = getattr(corpus, table)
        return read_footers(df.sparkSession, f"{corpus.folder}/{table}", df.schema) if corpus.folder else df
    parts = [rows(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Order-free digest of a table: row count, XOR and sum of row hashes."""
    columns = columns or df.columns
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    value = F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")
    return df.select(value.alias("h")).agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("xor_hash"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


# --- fixed values: names of the summary -------------------------------------
SUMMARY = ("documents", "units", "sentences", "fragments", "annotations", "aligned", "unmatched",
           "ambiguous", "single_label_sentences", "multi_label_sentences", "unlabeled_sentences",
           "high_confidence_single")
# --- end of fixed values ----------------------------------------------------


def build_manifest(corpus: Corpus, schema_version: str, source_revision: str = "unknown",
                   code_revision: str = "unknown", max_docs: int | None = None,
                   expected_docs: int = 1) -> DataFrame:
    """(key, value) rows; ``counts`` is a JSON object. Too few documents fail the build."""
    counts = stats.corpus_counts(corpus)
    subsets = corpus.documents.groupBy("subset").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("subset", "n")))).alias("subsets"))
    named: dict[str, Column] = {c: F.col(c) for c in (*SUMMARY, "subsets")}
    if max_docs is not None:
        named |= {"partial": F.lit(True), "max_docs": F.lit(max_docs)}
    fields = [named[c].alias(c) for c in sorted(named)]
    enough = F.when(F.col("documents") < expected_docs, F.raise_error(
        F.format_string("documents=%d below expected " + str(expected_docs), "documents")))
    row = counts.crossJoin(subsets).select(               # two single rows
        F.coalesce(enough.cast("string"), F.to_json(F.struct(*fields))).alias("counts"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("built_at"))
    entries = [("schema_version", F.lit(schema_version)), ("dataset_commit", F.lit(source_revision)),
               ("code_rev", F.lit(code_revision)), ("counts", F.col("counts")),
               ("built_at", F.col("built_at"))]
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries])).alias("e")).select("e.*")


def check_manifest(manifest: DataFrame | None, expected_version: str) -> dict:
    """ok, missing, missing_version or version_mismatch."""
    if manifest is None:
        return {"ok": False, "reason": "missing"}
    row = manifest.where("key = 'schema_version'").first()     # one key
    if row is None or not row["value"]:
        return {"ok": False, "reason": "missing_version"}
    if row["value"] != expected_version:
        return {"ok": False, "reason": "version_mismatch", "actual": row["value"],
                "expected": expected_version}
    return {"ok": True}


def corpus_slice(corpus: Corpus, per_subset: int) -> Corpus:
    """First documents of each subset by number, with all their rows.

    The few chosen ids are written once; all tables are restricted to them.
    """
    first = Window.partitionBy("subset").orderBy("num")
    ids = write_and_read(corpus.documents.select("doc_id", F.row_number().over(first).alias("_k"))
                         .where(F.col("_k") <= per_subset).select("doc_id"), "slice_ids")
    docs = corpus.documents.join(ids, "doc_id", "left_semi")
    rest = [getattr(corpus, t).join(ids, "doc_id", "left_semi")
            for t in ("annotations", "text_units", "unit_labels", "alignment", "ambiguous", "ladder", "page_index")]
    return Corpus(docs, *rest)
