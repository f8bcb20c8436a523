"""Training-set operators: label cap, document-grouped splits, quality reports."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.text import strip, text_key
from spanloom.operators.prefix import hash_bucket, hash_order, running_total
from spanloom.schema import LABEL_TOKENS
from spanloom.session import write_and_read

# --- fixed values -----------------------------------------------------------
SPLITS = ("train", "eval", "test")
UNLABELED = "UNLABELED"
UNLABELED_BIN = "__unlabeled__"
# --- end of fixed values ----------------------------------------------------

BUCKET_ROWS = 1 << 16     # rows of one document handled by one task


def label_token(label: Column) -> Column:
    """Fixed token of a known label, else an upper-case identifier."""
    known = F.create_map(*[F.lit(x) for kv in LABEL_TOKENS.items() for x in kv])
    spaced = F.replace(F.replace(F.replace(label, F.lit("/"), F.lit(" OR ")),
                                 F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    made = F.upper(F.regexp_replace(spaced, r"[^\p{L}\p{N}_]", ""))
    return F.coalesce(F.try_element_at(known, label), made)


def label_tokens(labels: Column) -> Column:
    """Tokens of a label array; an empty one counts as UNLABELED."""
    return F.when(F.size(labels) == 0, F.array(F.lit(UNLABELED))).otherwise(
        F.transform(labels, label_token))


# ---- cap -------------------------------------------------------------------

def cap_limits(rows: DataFrame, pct: float, doc: str = "doc_id", labels: str = "labels") -> DataFrame:
    """Rows allowed per label of each document, and what its rows look like."""
    limit = F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(float(pct)) / 100.0)).cast("long")
    return rows.groupBy(doc).agg(limit.alias("_limit"), F.count("*").alias("_rows"),
                                 F.max(F.size(labels)).alias("_most"))


def cap_labels(rows: DataFrame, pct: float, order: list[str], doc: str = "doc_id",
               labels: str = "labels", bucket: Column | None = None,
               row_id: str | None = None) -> DataFrame:
    """Keep at most ``pct`` percent of a document's rows per label.

    Rows are taken in ``order``; a row is dropped when any of its labels is used
    up, and only kept rows use labels up, each occurrence once. ``bucket`` cuts a
    document into ordered parts (default: ``position`` ranges). ``row_id`` names a
    unique column of rows that come from a table; without one, the rows are
    written with such a column first, as they are read several times.
    """
    if pct <= 0:
        return rows
    columns = rows.columns
    if row_id is None:
        row_id = "_row"
        rows = write_and_read(rows.withColumn(row_id, F.monotonically_increasing_id()), "cap_input")
    bucket = F.floor(F.col("position") / BUCKET_ROWS) if bucket is None else bucket
    names = F.when(F.size(labels) == 0, F.array(F.lit(UNLABELED))).otherwise(F.col(labels))
    # order, ids and labels only: the rows themselves stay in their table
    keys = rows.select(doc, row_id, names.alias("_names"), bucket.alias("_bucket"), *[
        F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    sized = keys.join(cap_limits(rows, pct, doc, labels), doc)
    places = [F.col(f"_o{i}") for i in range(len(order))] + [F.col(row_id)]

    # One label per row: labels do not interact, the rank decides.
    simple = sized.where("_most <= 1").withColumn("_label", F.get("_names", F.lit(0)))
    ranked = running_total(simple, [doc, "_label"], F.col("_bucket"), places, F.lit(1), "_rank")
    kept = ranked.where("_rank <= _limit").select(row_id)

    # Several labels per row: whether one is kept depends on the rows before it.
    joint = sized.where("_most > 1").select(
        F.col(doc).alias("_doc"), F.col(row_id).alias("_id"), "_names", "_limit", "_bucket",
        *[c for c in sized.columns if c.startswith("_o")], F.lit(None).cast("boolean").alias("_kept"))
    passed = jointly_kept(joint)[0].select(F.col("_id").alias(row_id))
    return rows.join(kept.unionByName(passed), row_id, "left_semi").select(*columns)


def jointly_kept(rows: DataFrame) -> tuple[DataFrame, int]:
    """(_id) of the rows that a cap with several labels a row keeps, and the rounds it took.

    ``rows`` has _doc, _id, _names, _limit, _bucket, places _o0, … and _kept (null: open).
    A task walks one bucket, never a document. It starts with bounds on how often each
    label is used up before: from below by kept rows, from above by kept and open ones.
    A row is dropped if a lower bound is at the limit, kept if no upper bound is, and
    open otherwise. In a document's first bucket with open rows both bounds are equal,
    so a round closes it: there are at most as many rounds as a document has buckets,
    and one for documents of one bucket.
    """
    places = [c for c in rows.columns if c.startswith("_o")] + ["_id"]
    bucket = ["_doc", "_bucket"]
    kept, closed, rounds = [], None, 0
    several = rows.groupBy("_doc").agg(F.min("_bucket").alias("_a"), F.max("_bucket").alias("_b")) \
        .where("_a < _b").select("_doc")
    while True:
        rounds += 1
        starts = _bounds_before(rows.join(several, "_doc", "left_semi"), closed)
        walked = rows.withColumns({"_low": F.lit(0).cast("long"), "_high": F.lit(-1).cast("long")}) \
            .unionByName(starts, allowMissingColumns=True)
        walked = write_and_read(walked.repartition(*bucket).sortWithinPartitions(
            *bucket, F.col("_high") < 0, *places).mapInArrow(_walk_bucket, rows.schema), "cap_walk")
        open_ = walked.where("_kept IS NULL").select(*bucket).distinct()
        if open_.isEmpty():
            kept.append(walked.where("_kept").select("_id"))
            return reduce(DataFrame.unionByName, kept), rounds
        open_ = write_and_read(open_, "cap_open")
        done = walked.join(open_, bucket, "left_anti")
        kept.append(done.where("_kept").select("_id"))
        used = _label_counts(done)
        closed = write_and_read(used if closed is None else used.unionByName(closed), "cap_closed")
        rows = walked.join(open_, bucket, "left_semi").select(*rows.columns)
        several = open_.select("_doc").distinct()


def _label_counts(rows: DataFrame) -> DataFrame:
    """Uses of each label in each bucket: at least ``low``, at most ``high``."""
    named = rows.where("_kept IS NULL OR _kept").select("_doc", "_bucket", "_kept", F.explode("_names").alias("_name"))
    return named.groupBy("_doc", "_bucket", "_name").agg(
        F.count_if(F.col("_kept")).alias("low"), F.count("*").alias("high"))


def _bounds_before(rows: DataFrame, closed: DataFrame | None) -> DataFrame:
    """Rows that give the walk of a bucket the uses of a label in the buckets before it."""
    counts = _label_counts(rows)
    if closed is not None:
        counts = counts.unionByName(closed)
    before = Window.partitionBy("_doc", "_name").orderBy("_bucket").rowsBetween(      # one row a bucket
        Window.unboundedPreceding, -1)
    sums = counts.withColumns({"_low": F.sum("low").over(before), "_high": F.sum("high").over(before)})
    return sums.where("_high > 0").select("_doc", "_bucket", F.array("_name").alias("_names"), "_low", "_high")


def _walk_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their ``_kept`` as far as it is settled; they come bucket by bucket, in order."""
    current, low, high = object(), Counter(), Counter()
    for batch in batches:
        own, found = [], []
        for i, (doc, part, names, limit, kept, below, above) in enumerate(zip(*(
                batch[c].to_pylist() for c in ("_doc", "_bucket", "_names", "_limit", "_kept", "_low", "_high")))):
            if (doc, part) != current:
                current, low, high = (doc, part), Counter(), Counter()
            if above >= 0:                                 # what the buckets before have used
                low[names[0]], high[names[0]] = below, above
                continue
            if kept is None:
                if any(low[n] >= limit for n in names):
                    kept = False
                elif all(high[n] < limit for n in names):
                    kept = True
            if kept:
                low.update(names)
            if kept is not False:
                high.update(names)
            own.append(i)
            found.append(kept)
        names = [n for n in batch.schema.names if n not in ("_low", "_high")]
        rows = batch.select(names).take(pa.array(own, pa.int64()))
        at = names.index("_kept")
        yield rows.set_column(at, "_kept", pa.array(found, pa.bool_()))


# ---- splits ----------------------------------------------------------------

def check_ratios(train: int, eval_: int, test: int) -> None:
    if train + eval_ + test != 100:
        raise ValueError("train/eval/test percentages must sum to 100")


def document_labels(rows: DataFrame, doc: str = "doc_id", labels: str = "labels") -> DataFrame:
    """Rows and distinct labels per document (sets of label sets: small)."""
    return rows.groupBy(doc).agg(
        F.count("*").alias("n"),
        F.array_distinct(F.flatten(F.collect_set(labels))).alias("doc_labels"))


def document_bins(docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Bin of each document: its rarest label by documents, then by name."""
    pairs = docs.select(doc, F.explode("doc_labels").alias("label"))
    counts = pairs.groupBy("label").agg(F.count("*").alias("_c"))
    rarest = pairs.join(counts, "label").groupBy(doc).agg(
        F.min(F.struct("_c", "label"))["label"].alias("bin"))
    return docs.join(rarest, doc, "left").select(
        doc, "n", F.coalesce("bin", F.lit(UNLABELED_BIN)).alias("bin"))


def _target(total: Column, pct: int) -> Column:
    """total * pct / 100 rounded half to even, in integers."""
    scaled = total * pct
    whole, rest = F.floor(scaled / 100).cast("long"), scaled % 100
    up = (rest > 50) | ((rest == 50) & (whole % 2 == 1))
    return whole + F.when(up, 1).otherwise(0)


def fill_splits(docs: DataFrame, train: int, eval_: int, test: int, seed: int,
                doc: str = "doc_id") -> DataFrame:
    """Assign whole documents (doc, bin, n) to splits, bin by bin.

    In seeded order documents fill train until its target is met, then eval, the
    rest is test. A document goes to train exactly while the rows before it are
    below the target, so prefix sums replace the loop. The document table is read
    several times and therefore written in between.
    """
    check_ratios(train, eval_, test)
    docs = write_and_read(docs.select(doc, "bin", "n", hash_order(seed, F.col(doc)).alias("_order")),
                          "split_docs")
    order = [F.col("_order"), F.col(doc)]
    placed = running_total(docs, ["bin"], hash_bucket(F.col("_order")), order, F.col("n"),
                           "_before", inclusive=False)
    totals = docs.groupBy("bin").agg(F.sum("n").alias("_total"))
    placed = placed.join(totals, "bin").withColumn("_in_train", (
        F.col("_before") < _target(F.col("_total"), train)) | F.lit(eval_ == 0 and test == 0))
    in_train = placed.groupBy("bin").agg(
        F.sum(F.when(F.col("_in_train"), F.col("n")).otherwise(0)).alias("_train_rows"))
    in_eval = (F.col("_before") - F.col("_train_rows")) < _target(F.col("_total"), eval_)
    rest = F.lit("test" if test > 0 else "train")
    split = (F.when(F.col("_in_train"), "train")
             .when(in_eval & F.lit(eval_ > 0), "eval").otherwise(rest))
    filled = write_and_read(placed.join(in_train, "bin").select(
        doc, "bin", "n", "_order", split.alias("split")), "split_filled")
    return _give_to_missing(filled, train, eval_, test, doc)


def _give_to_missing(filled: DataFrame, train: int, eval_: int, test: int, doc: str) -> DataFrame:
    """Every active split of a bin gets a document if the bin has enough.

    For each empty split the first document of the fullest split moves over; of
    equally full ones the one met first in order gives. At most two moves per
    bin, so the first three documents of each split are all that is needed.
    """
    active = [s for s, pct in zip(SPLITS, (1, eval_, test)) if pct > 0]
    key = F.struct("_order", doc)
    place = Window.partitionBy("bin", "split").orderBy("_order", doc)
    head = (filled.withColumn("_k", F.row_number().over(place)).where("_k <= 3")
            .groupBy("bin", "split").agg(F.array_sort(F.collect_list(key)).alias("docs")))
    sizes = filled.groupBy("bin", "split").agg(F.count("*").alias("c"))
    state = (sizes.join(head, ["bin", "split"]).groupBy("bin").agg(
        F.sum("c").alias("all"),
        F.collect_list(F.struct("split", "c", "docs")).alias("parts"))    # three entries at most
        .where(F.col("all") >= len(active)))
    for s in active:
        state = state.withColumn(
            f"_no_{s}", ~F.array_contains(F.col("parts.split"), F.lit(s)))
    state = state.where(reduce(lambda a, b: a | b, [F.col(f"_no_{s}") for s in active]))
    state = state.withColumn("moves", F.array().cast(
        f"array<struct<doc:struct<_order:string,{doc}:{dict(filled.dtypes)[doc]}>,to:string>>"))
    for s in active:
        # The fullest part, earliest first document on ties.
        giver = F.array_sort("parts", lambda a, b: F.when(
            (a["c"] > b["c"]) | ((a["c"] == b["c"]) & (a["docs"][0] < b["docs"][0])), -1).otherwise(1))
        state = state.withColumn("_g", F.get(giver, F.lit(0)))
        can = F.col(f"_no_{s}") & (F.col("_g.c") > 1)
        moved = F.get("_g.docs", F.lit(0))
        less = F.transform("parts", lambda p: F.when(
            p["split"] == F.col("_g.split"),
            F.struct(p["split"].alias("split"), (p["c"] - 1).alias("c"),
                     F.slice(p["docs"], 2, 3).alias("docs"))).otherwise(p))
        more = F.array(F.struct(F.lit(s).alias("split"), F.lit(1).cast("long").alias("c"),
                                F.array(moved).alias("docs")))
        state = state.withColumns({
            "moves": F.when(can, F.concat("moves", F.array(F.struct(
                moved.alias("doc"), F.lit(s).alias("to"))))).otherwise(F.col("moves")),
            "parts": F.when(can, F.concat(less, more)).otherwise(F.col("parts"))})
    moves = state.select(F.explode("moves").alias("m")).select(
        F.col(f"m.doc.{doc}").alias(doc), F.col("m.to").alias("_to"))
    return filled.join(moves, doc, "left").select(
        doc, "bin", "n", F.coalesce("_to", "split").alias("split"))


def document_splits(rows: DataFrame, train: int, eval_: int, test: int, seed: int = 42,
                    stratify: bool = True, doc: str = "doc_id", labels: str = "labels") -> DataFrame:
    """Split of every document: (doc, bin, n, split)."""
    if stratify:
        docs = write_and_read(document_labels(rows, doc, labels), "split_labels")
        sizes = document_bins(docs, doc)
    else:
        sizes = rows.groupBy(doc).agg(F.count("*").alias("n"), F.lit("").alias("bin"))
    return fill_splits(sizes, train, eval_, test, seed, doc)


def split_rows(rows: DataFrame, train: int, eval_: int, test: int, seed: int = 42,
               stratify: bool = True, doc: str = "doc_id", labels: str = "labels") -> DataFrame:
    """Add ``split``; all rows of a document share it."""
    splits = document_splits(rows, train, eval_, test, seed, stratify, doc, labels)
    return rows.join(splits.select(doc, "split"), doc)


def split_by_row(rows: DataFrame, train: int, eval_: int, test: int, seed: int, key: str) -> DataFrame:
    """Split single rows by their place in seeded order."""
    check_ratios(train, eval_, test)
    rows = rows.withColumn("_order", hash_order(seed, F.col(key)))
    placed = running_total(rows, [], hash_bucket(F.col("_order")), [F.col("_order"), F.col(key)],
                           F.lit(1), "_place")
    total = rows.agg(F.count("*").alias("_total"))
    train_end = _target(F.col("_total"), train)
    eval_end = train_end + _target(F.col("_total"), eval_)
    split = (F.when(F.col("_place") <= train_end, "train")
             .when(F.col("_place") <= eval_end, "eval").otherwise("test"))
    return placed.crossJoin(F.broadcast(total)).withColumn("split", split).drop(
        "_order", "_place", "_total")                    # a single total


# ---- reports ---------------------------------------------------------------

def label_histogram(rows: DataFrame, tokens: str = "label") -> DataFrame:
    """Rows per label token; a row with several labels counts for each."""
    return (rows.select(F.explode(tokens).alias("token")).groupBy("token")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token"))


def text_overlap(rows: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """Number of distinct texts that occur in more than one split.

    Texts are told apart by two 64-bit hashes, and splits are bits: short rows are
    shuffled, and the aggregate keeps numbers only.
    """
    bits = reduce(lambda c, i: c.when(F.col(split) == SPLITS[i], 1 << i), range(len(SPLITS)), F)
    per_text = rows.select(*text_key(strip(F.col(text))), bits.otherwise(0).alias("_bit")).groupBy(
        "_h1", "_h2").agg(F.bit_or("_bit").alias("_bits"))
    # empty texts are left out at the end: a condition before would strip every text once more
    empty = (F.col("_h1") == F.xxhash64(F.lit(""))) & (F.col("_h2") == text_key(F.lit(""))[1])
    return per_text.agg(F.count_if((F.bit_count("_bits") > 1) & ~empty).alias("overlapping_texts_count"))


def split_counts(rows: DataFrame) -> DataFrame:
    """One row with the rows of each split, zeros included."""
    return rows.agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def support_analysis(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per label token: rows, share, documents and annotator agreement.

    ``rows`` carries the token array ``label`` and the ``support`` pairs.
    """
    pairs = F.transform(F.coalesce("support", F.array().cast(
        "array<struct<label:string,k:bigint,pool:bigint,stars:int>>")), lambda s: F.named_struct(
            F.lit("token"), label_token(s["label"]), F.lit("k"), s["k"], F.lit("pool"), s["pool"],
            F.lit("stars"), s["stars"]))
    entries = rows.select(doc, F.explode("label").alias("token"), pairs.alias("_pairs")).select(
        doc, "token", F.try_element_at(F.filter(
            "_pairs", lambda p: p["token"] == F.col("token")), F.lit(-1)).alias("p"))
    ratio = F.when(F.col("p.pool") > 0, F.col("p.k") / F.col("p.pool"))
    per_doc = entries.groupBy("token", doc).agg(
        F.count("*").alias("c"), F.sum("p.k").alias("k"), F.sum(ratio).alias("r"),
        F.count(ratio).alias("info"), F.count_if(F.col("p.stars") == 3).alias("u"),
        F.count_if(F.col("p.stars") == 1).alias("d"))
    total = rows.agg(F.count("*").alias("_total"))

    def mean(c: str, digits: int) -> Column:
        info = F.sum("info")
        return F.when(info > 0, F.bround(F.sum(c) / info, digits)).otherwise(0.0)

    out = per_doc.groupBy("token").agg(
        F.sum("c").alias("raw_count"), F.count("*").alias("distinct_documents"),
        mean("k", 2).alias("avg_supporting_annotators"), mean("r", 4).alias("mean_agreement_rate"),
        F.sum("u").alias("unanimous_count"), F.sum("d").alias("disputed_count"))
    return (out.crossJoin(F.broadcast(total))             # a single total
            .withColumn("percentage_of_corpus", F.bround(F.col("raw_count") / F.col("_total") * 100.0, 2))
            .select("token", "raw_count", "percentage_of_corpus", "distinct_documents",
                    "avg_supporting_annotators", "mean_agreement_rate", "unanimous_count",
                    "disputed_count").orderBy(F.desc("raw_count"), "token"))
