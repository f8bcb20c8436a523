"""Queries that apply the operators of this subpackage to whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from spanloom.llm import (audit, bpe, lines, minhash, pii, posindex, quality, rollups, secrets, simhash, urls,
                          vectorcodes)
from spanloom.llm.common import read
from spanloom.llm.digests import DigestIndex
from spanloom.llm.rollups import Rollup
from spanloom.llm.spans import written
from spanloom.llm.urls import Rule
from spanloom.session import shared_dir

QUERIES = {}


def _count(spans, kind):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def query(f):
    QUERIES[f.__name__] = f
    return f


#: The rules that ``op1_url_filter`` is asked to apply.
URL_RULES = [Rule.of("allow", "com/"), Rule.of("block", "example.com/en/"),
             Rule.of("allow", "www.example.com/en/"), Rule.of("block", "net/es/"),
             Rule.of("block", "net/fr/")]
#: Pages with less html than this, in code points, are listed.
THIN_PAGE = 1000


@query
def op1_url_filter(spark, sf_dir):
    """Every page against the rules and the list of thin pages' canonical addresses."""
    pages = read(spark, sf_dir, "pages")
    host, path = urls.host_and_path(F.col("url"))
    thin = pages.where(F.length("html") < THIN_PAGE).select(host.alias("host"), path.alias("path"))
    listed = thin.where("host <> ''").select(urls.canonical(F.col("host"), F.col("path")).alias("canonical"))
    return urls.judge(pages.select("page_id", "url"), URL_RULES, listed).select(
        "page_id", "host", "path", "rule", "verdict")


@query
def op2_simhash(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"),
                        "component_id")


@query
def op3_token_rollup(spark, sf_dir):
    """All documents counted; those not in English recounted by another tokenizer; toxic ones removed.

    The first batch is then sent once more, which changes nothing.
    """
    docs = read(spark, sf_dir, "documents")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    foreign = docs.where(~F.col("lang").eqNullSafe("en"))
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    load = rollups.counts(docs, "words-1")
    rollup.apply("1-load", load)
    rollup.apply("2-recount", rollups.deletes(foreign, "words-1").unionByName(
        rollups.counts(foreign, "pieces-1")))
    rollup.apply("3-remove", rollups.deletes(toxic, "words-1").unionByName(
        rollups.deletes(toxic, "pieces-1")))
    rollup.apply("1-load", load)
    return rollup.totals()


@query
def op4_pairwise_quality(spark, sf_dir):
    found = quality.scores(read(spark, sf_dir, "documents"),
                           quality.training_labels(read(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op5_positional_index(spark, sf_dir):
    found = posindex.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op6_digest_index(spark, sf_dir):
    """Three batches of falling ids, so that the row that stays comes first; sizes over all of them."""
    index = DigestIndex(spark, f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cuts = docs.agg(F.percentile_approx("doc_id", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    low, high = F.col("doc_id") < cuts[0], F.col("doc_id") >= cuts[1]
    parts = [high, ~low & ~high, F.coalesce(low, F.lit(True))]
    found = [index.ingest(docs.where(p), str(i)) for i, p in enumerate(parts)]
    rows = reduce(DataFrame.unionByName, found).drop("group_size")
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size"))
    return rows.join(sizes, "digest").select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query
def op7_weak_pii(spark, sf_dir):
    found = pii.find(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[_count("base", k) for k in pii.KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))


@query
def op8_bpe(spark, sf_dir):
    return bpe.round_trip(read(spark, sf_dir, "documents"), ["doc_id"])


@query
def op9_trigram_secrets(spark, sf_dir):
    found = secrets.find(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    rows = found.select("doc_id", "spans", base.alias("base"))
    return rows.select(
        "doc_id", *[_count("base", k) for k in ("assign", "access", "hex")],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"))


@query
def op10_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                          F.sha2("text", 256).alias("kept_sha256"))


@query
def op11_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words_in=2)


@query
def op12_filter_audit(spark, sf_dir):
    return audit.interaction(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op13_vector_codes(spark, sf_dir):
    return vectorcodes.compress(read(spark, sf_dir, "embeddings")).drop("label")
