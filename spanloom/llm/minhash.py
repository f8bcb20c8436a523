"""Near copies by MinHash: banded candidates, sequential Bayesian pruning, exact sets.

A text is the set of its hashed word shingles; equal sets are folded. Each set has 256
minima of its hashes under as many orders. Bands of the first 128 are bucket keys: sets
that agree in a band meet. A met pair is compared by batches of its signature, a byte
a minimum, and goes as soon as the posterior probability that the pair is similar
enough falls below ``miss`` (uniform prior: it is a binomial sum). What is left is
verified on the whole sets.

No bucket is compared in all pairs. Its hub, the set that shares the largest buckets
elsewhere, is compared with the others first; linked sets need no more comparison, nor
does the hub. Buckets that are still in several components get another hub, as long as
that halves what is open. In the rest, only sets of different components meet, and only
if a bound allows it that misses no pair: every set has 512 bits, each shingle flips one,
and two sets have at least as many different shingles as different bits.

Two sets of similarity 0.8 share none of the 32 bands of 4 with probability 5e-8.

Rows: a null text and one without words have the empty set, which is linked with
nothing, or with other empty ones if ``link_empty`` is set; a text of fewer words than a shingle is one shingle. Rows with the same id
are one document and linked, unless one is empty; rows without an id count as the
largest id. Hashes of 64 bits stand for shingles and sets. Extra columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from math import comb
from typing import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField

from spanloom.llm.common import NULL_ID, per_row, staged
from spanloom.llm.components import _thin, components
from spanloom.llm.countfilter import filter_bits, hits

HASHES, BATCH = 256, 64
BANDS, ROWS = 32, 4
#: Links that one task may join.
FEW_LINKS = 1 << 14
#: Longs with the parity bits of a set.
PARITIES = [f"p{i}" for i in range(8)]


def _numbers(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name}{i}") for i in range(n)], np.uint64)


_FLIP, _TIMES = _numbers("flip", HASHES)[:, None], _numbers("times", HASHES)[:, None] | np.uint64(1)
_KEY = _numbers("key", ROWS) | np.uint64(1)


def shingles(text: str | None, words_in: int) -> np.ndarray:
    """Sorted hashes of the different lower-cased word shingles of a text."""
    words = (text or "").encode().lower().split()          # the six ASCII spaces
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    k = min(words_in, len(words))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(
        (ends - lengths)[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64))


def _node(grams: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(grams.tobytes())
    return value - (1 << 64) if value >> 63 else value


def minima(grams: np.ndarray) -> np.ndarray:
    """The smallest of the hashes ``grams`` in each of ``HASHES`` orders, as 32 bits."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for i in range(0, len(grams), 512):
        np.minimum(least, ((grams[None, i:i + 512] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    return least >> np.uint64(32)


def band_keys(mins: np.ndarray) -> np.ndarray:
    """A key for each band; bands do not meet each other's."""
    bands = mins[:BANDS * ROWS].reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        key = (key ^ bands[:, i]) * _KEY[i]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def parity(grams: np.ndarray) -> np.ndarray:
    """512 bits as longs: whether an odd number of shingles falls on a bit."""
    odd = np.bincount((grams >> np.uint64(3)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(own: DataFrame, words_in: int, link_empty: bool = False) -> DataFrame:
    """(id, node, n, keys, sig, p0, …): hash and size of the set, its band keys, a byte for
    each minimum, and its parity bits. Empty sets have no node, or one if they are linked."""
    def run(texts: Iterable[str | None]) -> Iterator[tuple]:
        for x in texts:
            grams = shingles(x, words_in)
            mins = minima(grams)
            yield (_node(grams) if len(grams) or link_empty else None, len(grams), band_keys(mins) if len(grams) else [],
                   mins.astype(np.uint8).tobytes(), *parity(grams).tolist())
    return per_row(own, ["id"], "text", [
        StructField("node", LongType()), StructField("n", LongType()),
        StructField("keys", ArrayType(LongType())), StructField("sig", BinaryType()),
        *[StructField(p, LongType()) for p in PARITIES]], run)


# ---- pruning -------------------------------------------------------------------

def least_matches(n: int, percent: int, miss: float) -> int:
    """Fewest of ``n`` matches after which the similarity is likely enough to be ``percent``.

    With a uniform prior, P(similarity >= t | m of n) = P(Bin(n + 1, t) <= m).
    """
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n + 1


def _matched(start: int, end: int, percent: int, miss: float):
    """Pairs (a, b, m) that the batches ``start`` to ``end`` leave; ``m`` counts matches so far."""
    least = {n: least_matches(n, percent, miss) for n in range(start + BATCH, end + 1, BATCH)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, end - start)
                    for c in (3, 4))
            m = batch.column(2).to_numpy(zero_copy_only=False).copy()
            left = np.arange(len(m))
            for n in range(start, end, BATCH):
                own = slice(n - start, n - start + BATCH)
                m[left] += (x[left, own] == y[left, own]).sum(axis=1)
                left = left[m[left] >= least[n + BATCH]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left)),
                                              batch.column(1).take(pa.array(left)), pa.array(m[left])],
                                             ["a", "b", "m"])
    return run


def likely(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b) of ``pairs`` that may be similar enough by their signatures.

    The first batch is fetched and compared before the others are.
    """
    found = pairs.select("a", "b", F.lit(0).cast("long").alias("m"))
    for start, end in ((0, BATCH), (BATCH, HASHES)):
        a, b = (sigs.select(F.col("node").alias(x), F.substring("sig", start + 1, end - start).alias(f"s{x}"))
                for x in "ab")
        found = found.join(a, "a").join(b, "b").select("a", "b", "m", "sa", "sb").mapInArrow(
            _matched(start, end, percent, miss), "a long, b long, m long")
    return found.select("a", "b")


# ---- whole sets ------------------------------------------------------------------

def whole_sets(own: DataFrame, nodes: DataFrame, words_in: int) -> DataFrame:
    """(node, grams) of ``nodes`` (node, id), hashed again from the texts of their ids.

    A Bloom filter of the ids keeps other texts from being hashed and shuffled.
    """
    bits = own.sparkSession.sparkContext.broadcast(filter_bits(nodes.select(F.xxhash64("id")), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.flatnonzero(hits(bits.value, batch.column(0).to_numpy(zero_copy_only=False)))
            sets = [shingles(batch.column(1)[i].as_py(), words_in) for i in at]
            sets = [x for x in sets if len(x)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_node(x) for x in sets], pa.int64()),
                 pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "grams"])
    found = own.select(F.xxhash64("id"), "text").mapInArrow(run, "node long, grams array<long>")
    return found.join(nodes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = (sets.select(F.col("node").alias(x), F.col("grams").alias(f"{x}_grams")) for x in "ab")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    return pairs.join(a, "a").join(b, "b").where(
        both * (100 + percent) >= (F.size("a_grams") + F.size("b_grams")) * percent).select("a", "b")


# ---- links and classes -------------------------------------------------------------

def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the components of all links in a partition, which has ``FEW_LINKS`` at most."""
    found = list(batches)
    if found:
        yield from _thin(iter(pa.Table.from_batches(found).combine_chunks().to_batches()))


def joined(pairs: DataFrame) -> DataFrame:
    """(node, component) of the written links ``pairs``; a few of them are joined in one task."""
    if pairs.count() > FEW_LINKS:
        return components(pairs)
    stars = staged(pairs.select("a", "b").repartition(1).mapInArrow(_gathered, "a long, b long"), "stars_of_links")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def links_of(found: DataFrame, own: DataFrame, held: DataFrame, percent: int, words_in: int,
             known: DataFrame | None = None) -> DataFrame:
    """(a, b) node pairs of the id pairs ``found`` (a, b) whose whole sets are similar enough.

    Of an id of several texts, one set is compared: its sets are linked anyway. Written links
    ``known`` are among the result: pairs that they join are not compared.
    """
    one = held.where("n > 0").groupBy("id").agg(F.min(F.struct("node", "n")).alias("_s"))
    x, y = (one.select(F.col("id").alias(c), F.col("_s.node").alias(f"node_{c}"),
                       F.col("_s.n").alias(f"n_{c}")) for c in "ab")
    pairs = found.join(x, "a").join(y, "b").where("node_a <> node_b").where(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    if known is not None:
        placed = joined(known)
        for c in "ab":
            pairs = pairs.join(placed.select(F.col("node").alias(f"node_{c}"), F.col("component").alias(f"own_{c}")),
                               f"node_{c}", "left")
        pairs = pairs.where(F.coalesce("own_a", "node_a") != F.coalesce("own_b", "node_b"))
    pairs = staged(pairs.select(
        F.col("a").alias("id_a"), F.col("b").alias("id_b"),
        F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")), "pairs_of_ids")
    nodes = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().join(held, "id").where(
        "n > 0").groupBy("node").agg(F.min("id").alias("id"))
    sets = staged(whole_sets(own, staged(nodes, "nodes_of_ids"), words_in), "sets_of_pairs")
    more = staged(_similar(pairs.select("a", "b").distinct(), sets, percent), "links_of_pairs")
    return more if known is None else known.unionByName(more)


def links(own: DataFrame, signed: DataFrame, percent: int, words_in: int, miss: float,
          found: DataFrame | None = None) -> DataFrame:
    """(a, b) node pairs, enough to connect all sets of ``percent`` similarity or more.

    ``found`` are written links known before, which are among the result: what they join
    is not compared again.
    """
    one = staged(signed.where("n > 0").groupBy("node").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "sets_of_ids")
    entries = one.select("node", "n", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = staged(entries.join(buckets, "key"), "met")
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    open_ = met.join(weights, "node").select("key", "node", "n", "weight")

    def still_open(rest: DataFrame, found: DataFrame) -> DataFrame:
        """Buckets whose sets the links leave in several components."""
        rest = rest.join(joined(found), "node", "left").withColumn(
            "own", F.coalesce("component", "node")).drop("component")
        several = rest.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high")) \
            .where("low < high").select("key")
        return staged(rest.join(several, "key", "left_semi"), "open")

    open_ = (staged(open_.withColumn("own", F.col("node")), "open") if found is None
             else still_open(staged(open_, "met_open"), found))
    nodes = staged(weights.select("node").join(one.select("node", "id"), "node"), "met_nodes")
    sigs = staged(signed.join(nodes.select("node"), "node", "left_semi").select("node", "sig", *PARITIES)
                  .dropDuplicates(["node"]), "met_signatures")
    sets = staged(whole_sets(own, nodes, words_in), "met_sets")

    def verified(pairs: DataFrame) -> DataFrame:
        left = staged(likely(pairs.distinct(), sigs, percent, miss), "likely")
        return staged(_similar(left, sets, percent), "similar")

    def sizes_fit(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    before = None
    while rows := open_.count():
        if before is not None and 2 * rows > before:
            bits = open_.join(sigs.select("node", *PARITIES), "node")
            x, y = (bits.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "own", *PARITIES)])
                    for s in "xy")
            differ = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITIES), F.lit(0))
            pairs = x.join(y, (x["key"] == y["key"]) & (F.col("own_x") < F.col("own_y")) & sizes_fit("n_x", "n_y")
                           & (differ * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)))
            last = verified(pairs.select(F.least("node_x", "node_y").alias("a"),
                                         F.greatest("node_x", "node_y").alias("b")))
            return found.unionByName(last)
        before = rows
        hubs = open_.groupBy("key").agg(F.max_by(
            F.struct("node", "n", "own"), F.struct("weight", "node")).alias("hub"))
        stars = staged(open_.join(hubs, "key").where("node <> hub.node"), "stars")
        pairs = stars.where("own <> hub.own").where(sizes_fit("n", "hub.n")).select(
            F.col("hub.node").alias("a"), F.col("node").alias("b"))
        more = verified(pairs)
        found = more if found is None else found.unionByName(more)
        open_ = still_open(stars.select("key", "node", "n", "weight"), found)
    return found if found is not None else own.sparkSession.createDataFrame([], "a long, b long")


def near_copies(docs: DataFrame, percent: int = 80, words_in: int = 5, miss: float = 1e-9,
                doc_id: str = "doc_id", text: str = "text", link_empty: bool = False,
                pairs: DataFrame | Sequence[DataFrame] = ()) -> DataFrame:
    """(id, n_shingles, first), one row for each row of ``docs``: the size of its set and
    the smallest id that can be reached over links. No id is ``NULL_ID``.

    Links join documents whose shingle sets have a Jaccard similarity of ``percent``
    hundredths or more. ``pairs`` (a, b) of ids that another method found are compared
    first, on whole sets, one table of them after the other; the bands find what these leave.
    """
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("id"),
                      F.col(text).alias("text"))
    signed = staged(signatures(own, words_in, link_empty), "signatures")
    held = signed.select("id", "node", "n")
    same = held.groupBy("id").agg(F.min("node").alias("least"), F.max("node").alias("most")) \
        .where("least < most").select("id", "least")       # an id of several texts
    same_id = held.join(same, "id").where("node <> least").select(
        F.col("node").alias("a"), F.col("least").alias("b"))
    known = None
    for found in [pairs] if isinstance(pairs, DataFrame) else pairs:
        known = links_of(found, own, held, percent, words_in, known)
    found = joined(staged(links(own, signed, percent, words_in, miss, known).unionByName(same_id), "all_links"))
    placed = held.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id")).join(
        found, "node", "left").select("node", "id", F.coalesce("component", "node").alias("own"))
    least = placed.groupBy("own").agg(F.min("id").alias("first"))
    classes = staged(placed.join(least, "own").select("node", "first"), "classes")
    return held.join(classes, "node", "left").select(
        "id", F.col("n").alias("n_shingles"), F.coalesce("first", "id").alias("first"))


def near_duplicates(docs: DataFrame, percent: int = 80, words_in: int = 5, miss: float = 1e-9,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    A class of rows without an id has a null ``component_id``, and they stay.
    """
    found = near_copies(docs, percent, words_in, miss, doc_id, text)

    def named(c: str):
        return F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(named("id").alias(doc_id), "n_shingles", named("first").alias("component_id"),
                        (F.col("id") == F.col("first")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80, words_in: int = 5, miss: float = 1e-9,
               doc_id: str = "doc_id", text: str = "text", link_empty: bool = False,
               pairs: DataFrame | Sequence[DataFrame] = ()) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its class; rows with one id go together."""
    lost = staged(near_copies(docs, percent, words_in, miss, doc_id, text, link_empty, pairs).where("id <> first")
                  .select(F.col("id").alias("_lost")).distinct(), "lost")
    return docs.join(lost, F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)) == lost["_lost"],
                     "left_anti")
