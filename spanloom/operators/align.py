"""Three-tier alignment of annotator spans to the text units of their document.

A  the span lies in exactly one unit            -> annotation_in_sentence
   (in several units: ambiguous, no alignment)
B  units of more than 10 characters lie in it   -> sentence_in_annotation_paragraph
C  the first unit with the largest share of its
   tokens, at least 55 %                        -> partial_overlap

Each tier sees only what the tiers before it left. Equal texts of a document are
folded first, so copies are compared once and expanded at the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.rows import exploded
from spanloom.functions.text import normalize, normalize_safe, tokens, words
from spanloom.operators.containment import contained_pairs
from spanloom.schema import IN_PARAGRAPH, IN_SENTENCE, OVERLAP
from spanloom.session import write_and_read

# --- fixed values -----------------------------------------------------------
MIN_UNIT_CHARS = 10      # a unit inside a span must be longer than this
MIN_SPAN_TOKENS = 3      # distinct tokens a span needs for the overlap tier
# The overlap limit 0.55 as a fraction, so that 11 of 20 is in and no rounding counts.
LIMIT_NUM, LIMIT_DEN = 11, 20
# --- end of fixed values ----------------------------------------------------

#: Characters of units and spans in one task up to which joins hash them instead of sorting.
HASH_CHARS = 1 << 26
ROW_CHARS = 64           # what a row counts beside its text


@dataclass
class Alignment:
    """Outcome of one alignment run."""
    spans: DataFrame       # input spans + status, n_hits
    alignment: DataFrame   # one row per aligned (unit, span)
    ambiguous: DataFrame   # one row per candidate unit of an ambiguous span


def unit_texts(units: DataFrame) -> DataFrame:
    """Distinct normalised unit texts per document; ``unit_rep`` is the first position.

    A unit is a sentence or a fragment: its kind follows from numbers, which are grouped by
    hashes. A string in the buffer, as of min_by, would make Spark sort the texts. Units
    without a column ``unit_kind`` give texts without ``first_kind``.
    """
    if "unit_kind" not in units.columns:
        return units.where("norm <> ''").groupBy("doc_id", "norm").agg(
            F.min("position").alias("unit_rep"), F.count("*").alias("n_units"))
    found = units.where("norm <> ''").groupBy("doc_id", "norm").agg(
        F.min("position").alias("unit_rep"),
        F.min(F.when(F.col("unit_kind") == "sentence", F.col("position"))).alias("_sentence"),
        F.count("*").alias("n_units"))
    kind = F.when(F.col("_sentence") == F.col("unit_rep"), "sentence").otherwise("fragment")
    return found.select("doc_id", "norm", "unit_rep", kind.alias("first_kind"), "n_units")


def span_texts(spans: DataFrame) -> DataFrame:
    return spans.where("norm <> ''").groupBy("doc_id", "norm").agg(
        F.min("src_row").alias("span_rep"))


def with_norms(rows: DataFrame, text: str, keep: Callable[[DataFrame, str], DataFrame], name: str) -> DataFrame:
    """``rows`` with the comparison form ``norm`` of a text column, kept under ``name``.

    Only if there are strings that need NFKC, the table is written a second time, by way of Python.
    """
    found = keep(rows.withColumn("norm", normalize_safe(F.col(text))), name)
    if found.where("norm is null").isEmpty():
        return found
    other = normalize(F.when(F.col("norm").isNull(), F.col(text)))
    return keep(found.withColumn("norm", F.coalesce("norm", other)), f"{name}_nfkc")


def hashes(*tables: DataFrame, tasks: int | None = None) -> bool:
    """Whether the rows (doc_id, norm) that a task gets of all tables fit a hash table.

    Sorts can spill, hash tables cannot: joins of larger shares sort. ``tasks`` is the
    number of tasks by document (default: the session's shuffle partitions).
    """
    tasks = tasks or int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = reduce(DataFrame.unionByName, [t.select(
        F.pmod(F.hash("doc_id"), F.lit(tasks)).alias("task"), (F.length("norm") + ROW_CHARS).alias("c")).groupBy(
            "task").agg(F.sum("c").alias("c")) for t in tables])
    largest = sizes.groupBy("task").agg(F.sum("c").alias("c")).agg(F.max("c")).first()[0]
    return (largest or 0) <= HASH_CHARS


def _built(df: DataFrame, hashed: bool) -> DataFrame:
    """The side of a join that a hash table is made of."""
    return df.hint("shuffle_hash") if hashed else df


def contained_in_units(stexts: DataFrame, utexts: DataFrame, hashed: bool = False) -> DataFrame:
    """Tier A pairs with the number of units behind each unit text."""
    needles = stexts.select("doc_id", F.col("span_rep").alias("needle_id"),
                            F.col("norm").alias("needle_text"))
    hay = utexts.select("doc_id", F.col("unit_rep").alias("hay_id"),
                        F.col("norm").alias("hay_text"), "first_kind", "n_units")
    return contained_pairs(needles, hay, ["doc_id"], hashed=hashed).select(
        "doc_id", F.col("needle_id").alias("span_rep"), F.col("hay_id").alias("unit_rep"),
        "first_kind", "n_units")


def containing_units(stexts: DataFrame, utexts: DataFrame, hashed: bool = False) -> DataFrame:
    """Tier B pairs: unit texts inside the span."""
    needles = utexts.where(F.length("norm") > MIN_UNIT_CHARS).select(
        "doc_id", F.col("unit_rep").alias("needle_id"), F.col("norm").alias("needle_text"))
    hay = stexts.select("doc_id", F.col("span_rep").alias("hay_id"), F.col("norm").alias("hay_text"))
    return contained_pairs(needles, hay, ["doc_id"], fold="hay", hashed=hashed).select(
        "doc_id", F.col("hay_id").alias("span_rep"), F.col("needle_id").alias("unit_rep"))


def _needed(n: Column) -> Column:
    """Smallest overlap count that reaches the limit for ``n`` span tokens."""
    return ((n * LIMIT_NUM + (LIMIT_DEN - 1)) / LIMIT_DEN).cast("int")


def best_overlap(stexts: DataFrame, utexts: DataFrame,
                 keep: Callable[[DataFrame, str], DataFrame] = write_and_read,
                 hashed: bool | None = None) -> DataFrame:
    """Tier C: per span the unit text with most shared tokens, earliest on ties.

    A unit that holds ``need`` of the n span tokens misses at most n - need, so
    it holds one of any n - need + 1 of them. Joining on the rarest ones keeps
    the candidates few and the result exact. Units of fewer than ``need`` tokens are
    no candidates. Both tables are read more than once: the caller writes them.
    Tokens are counted and joined by their hashes, those of units only if a span of the
    document has them; candidates are compared by the tokens themselves. Span tokens, the
    rows of unit tokens and the candidates are kept: they are read several times, and
    the joins of one plan would make code too long to be compiled. ``hashed`` (default:
    measured) says that joins may hash the texts of a task. The kind of the unit text is
    among the result if it is known.
    """
    hashed = hashes(stexts, utexts) if hashed is None else hashed
    named = [c for c in ("unit_rep", "first_kind") if c in utexts.columns]
    s = keep(stexts.select("doc_id", "span_rep", tokens(F.col("norm")).alias("s_tokens"))
             .withColumn("n", F.size("s_tokens")).where(F.col("n") >= MIN_SPAN_TOKENS)
             .withColumn("need", _needed(F.col("n"))), "span_tokens")
    u = (utexts.join(_built(s.select("doc_id").distinct(), hashed), "doc_id", "left_semi")
         .select("doc_id", "unit_rep", tokens(F.col("norm")).alias("u_tokens"))
         .withColumn("m", F.coalesce(F.size("u_tokens"), F.lit(0))))      # never NULL: no filter repeats the tokens
    s_rows = exploded(s, ["doc_id", "span_rep", "n", "need"], F.col("s_tokens"), "_t").withColumn(
        "token", F.xxhash64("_t")).drop("_t")
    asked = s_rows.groupBy("doc_id", "token").agg(F.min("need").alias("least"))
    u_rows = keep(exploded(u, ["doc_id", "unit_rep", "m"], F.col("u_tokens"), "_t").select(
        "doc_id", "unit_rep", "m", F.xxhash64("_t").alias("token")).join(
        _built(asked, hashed), ["doc_id", "token"]).where("m >= least").drop("least"), "unit_tokens")
    frequency = u_rows.groupBy("doc_id", "token").agg(F.count("*").alias("df"))

    rarest = Window.partitionBy("doc_id", "span_rep").orderBy("df", "token")
    prefix = (s_rows.join(_built(frequency, hashed), ["doc_id", "token"], "left")
              .withColumn("rank", F.row_number().over(rarest))   # one span's tokens
              .where("rank <= n - need + 1 and df is not null")
              .select("doc_id", "span_rep", "token", "need"))
    candidates = keep(u_rows.join(_built(prefix, hashed), ["doc_id", "token"]).where("m >= need")
                      .select("doc_id", "span_rep", "unit_rep").distinct(), "candidates")
    scored = (candidates
              .join(_built(s.select("doc_id", "span_rep", "s_tokens", "need"), hashed), ["doc_id", "span_rep"])
              .join(_built(utexts.select("doc_id", *named, "norm"), hashed), ["doc_id", "unit_rep"])
              .withColumn("shared", F.size(F.array_intersect("s_tokens", words(F.col("norm")))))
              .where("shared >= need"))
    best = F.max_by(F.struct(*named), F.struct(F.col("shared"), -F.col("unit_rep")))
    return (scored.groupBy("doc_id", "span_rep").agg(best.alias("b"))
            .select("doc_id", "span_rep", *[f"b.{c}" for c in named]))


def align(units: DataFrame, spans: DataFrame,
          keep: Callable[[DataFrame, str], DataFrame] = write_and_read,
          tasks: int | None = None, fits: Callable[[], None] = lambda: None) -> Alignment:
    """Align ``spans`` (annotation_id, doc_id, src_row, text, label, ranumb, …) to
    ``units`` (doc_id, position, unit_id, unit_kind, unit_text or, if it is there, norm).

    ``keep`` writes a table under a name and reads it back: every later tier and the
    final tables read tier results more than once. ``tasks`` as in ``hashes``;
    ``fits`` is called if the texts of a task fit a hash table.
    """
    key = ["doc_id", "span_rep"]
    if "norm" not in units.columns:
        units = with_norms(units.select("doc_id", "position", "unit_id", "unit_kind", "unit_text"),
                           "unit_text", keep, "unit_norms")
    u = units.select("doc_id", "position", "unit_id", "unit_kind", "norm")
    s = with_norms(spans, "text", keep, "span_norms")
    hashed = hashes(u, s, tasks=tasks)
    if hashed:
        fits()
    utexts = keep(unit_texts(u), "unit_texts")
    stexts = keep(span_texts(s), "span_texts")

    a_pairs = keep(contained_in_units(stexts, utexts, hashed), "tier_a")
    a = a_pairs.groupBy(*key).agg(F.sum("n_units").alias("n_hits"),
                                  F.min("unit_rep").alias("unit_rep"),
                                  F.min("first_kind").alias("first_kind"))
    left_b = keep(stexts.join(a, key, "left_anti"), "left_b")
    b_pairs = keep(containing_units(left_b, utexts, hashed), "tier_b")
    left_c = left_b.join(b_pairs, key, "left_anti")
    c = keep(best_overlap(keep(left_c, "left_c"), utexts, keep, hashed), "tier_c")

    # Outcome per span text. A and C name one unit, B a unit text.
    single = (a.where("n_hits = 1").select(*key, "unit_rep", "first_kind",
                                           F.lit(IN_SENTENCE).alias("alignment_type"))
              .unionByName(c.select(*key, "unit_rep", "first_kind",
                                    F.lit(OVERLAP).alias("alignment_type"))))
    span_keys = (s.join(_built(stexts, hashed), ["doc_id", "norm"], "left")
                 .select(*spans.columns, "span_rep"))
    unit_keys = _built(u.join(_built(utexts, hashed), ["doc_id", "norm"]).select(
        "doc_id", "unit_rep", "position", "unit_id", "unit_kind"), hashed)

    outcome = (a.select(*key, F.when(F.col("n_hits") == 1, "aligned").otherwise("ambiguous")
                        .alias("status"), "n_hits")
               .unionByName(b_pairs.groupBy(*key).agg(F.lit("aligned").alias("status"),
                                                      F.count("*").alias("n_hits")))
               .unionByName(c.select(*key, F.lit("aligned").alias("status"),
                                     F.lit(1).cast("long").alias("n_hits"))))
    statuses = span_keys.join(_built(outcome, hashed), key, "left").withColumns({
        "status": F.coalesce("status", F.lit("unmatched")),
        "n_hits": F.when(F.col("status") == "ambiguous", F.col("n_hits"))})

    who = _built(span_keys.select(*key, "annotation_id", "label", "ranumb"), hashed)
    columns = ["unit_id", "annotation_id", "alignment_type", "doc_id", "label", "ranumb",
               "unit_kind"]
    one = (single.join(who, key)
           .withColumn("unit_id", F.concat(F.col("doc_id"), F.lit("_U"), F.col("unit_rep")))
           .withColumnRenamed("first_kind", "unit_kind"))
    whole = (b_pairs.join(unit_keys, ["doc_id", "unit_rep"]).join(who, key)
             .withColumn("alignment_type", F.lit(IN_PARAGRAPH)))
    alignment = one.select(*columns).unionByName(whole.select(*columns))

    several = a.where("n_hits > 1").select(*key)
    # per span text: spans of the same text in a document share ``span_rep``
    ambiguous = (a_pairs.join(several, key, "left_semi").select(*key, "unit_rep")
                 .join(unit_keys, ["doc_id", "unit_rep"]).select(*key, "unit_id", "position"))
    return Alignment(statuses, alignment, ambiguous)
