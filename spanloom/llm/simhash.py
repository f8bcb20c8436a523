"""SimHash near-duplicates: multi-index hashing and connected components.

A fingerprint of 64 bits is cut into segments. Two fingerprints at ``distance``
or fewer bits agree, by the pigeonhole principle, up to a small radius in at
least one segment. Every fingerprint is entered in a table under each of its
segments; small Hamming balls around the segments are enumerated and looked up
there, and the whole distance is verified. Equal fingerprints are folded before.

Buckets that hold very many different fingerprints are not compared in pairs.
There, two members are linked exactly if the balls of half the distance around
their other bits meet, so each member is joined to the points of its own ball:
linear in the members, and no link is lost.

Rows: a null or empty text has the fingerprint zero and is linked like any
other. Rows with the same id are one document, and so are rows that are the first
of their text but have no id: no id counts as the largest, and a class of such
rows has a null ``component_id``. Each row gets an answer. Extra columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from typing import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField

from spanloom.llm.common import NULL_ID, per_row, staged
from spanloom.llm.components import components

BITS = 64
#: Hash values that are turned into bits at once.
CHUNK = 1 << 15


def fingerprint(text: str | None, words_in: int = 4, seed: int = 42) -> int:
    """SimHash of the lower-cased word shingles of a text, as an unsigned number."""
    raw = (text or "").encode().lower()
    words = raw.split()                       # the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words_in, len(words))
    hashes = [xxhash.xxh64_intdigest(joined[a:b], seed)
              for a, b in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i:i + CHUNK], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_in: int = 4, seed: int = 42, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, fp): ``fp`` holds the 64 bits as a signed number."""
    def run(texts: Iterable[str | None]) -> Iterator[tuple]:
        for x in texts:
            value = fingerprint(x, words_in, seed)
            yield (value - (1 << 64) if value >> 63 else value,)
    return per_row(docs, [doc_id], text, [StructField("fp", LongType())], run)


def plan(distance: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment, radius -1 where no lookup is needed."""
    widths = [BITS // segments + (i < BITS % segments) for i in range(segments)]
    radius, rest = divmod(distance, segments)
    out, at = [], 0
    for i, width in enumerate(widths):
        out.append((at, width, radius if i <= rest else radius - 1))
        at += width
    return out


def _masks(width: int, radius: int) -> list[int]:
    """All sets of up to ``radius`` of ``width`` bits, none of them first."""
    return [sum(1 << b for b in bits) for r in range(radius + 1)
            for bits in combinations(range(width), r)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(at: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def _asked(seg: int, key: Column, masks: list[int]) -> Column:
    """Keys to look up; of two that differ in a segment, the one with the smaller value asks."""
    near = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]),
                       lambda m: key.bitwiseXOR(m))
    return F.transform(F.filter(near, lambda k: k >= key), lambda k: F.struct(
        F.lit(seg).alias("seg"), k.alias("key"), (k == key).alias("own")))


def links(nodes: DataFrame, distance: int = 4, segments: int = 3,
          crowded: int = 1024) -> DataFrame:
    """(a, b) node pairs, enough to connect all fingerprints at ``distance`` or fewer bits.

    ``nodes`` has unique ``fp`` with a unique ``node``. ``crowded`` is the bucket size
    from which balls are joined instead of pairs; it changes the cost, not the classes.
    """
    parts = [x for x in plan(distance, segments) if x[2] >= 0]
    keys = [_key(at, width) for at, width, _ in parts]
    stands = [F.struct(F.lit(i).alias("seg"), key.alias("key")) for i, key in enumerate(keys)]
    asks = [_asked(i, key, _masks(width, radius))
            for i, (key, (_, width, radius)) in enumerate(zip(keys, parts))]
    standing = nodes.select("node", "fp", F.inline(F.array(*stands)))
    asking = nodes.select("node", "fp", F.inline(F.flatten(F.array(*asks))))
    full = staged(standing.groupBy("seg", "key").count().where(F.col("count") > crowded)
                  .select("seg", "key"), "crowded")
    a = asking.alias("a")
    b = standing.join(full, ["seg", "key"], "left_anti").alias("b")
    pairs = a.join(b, (F.col("a.seg") == F.col("b.seg")) & (F.col("a.key") == F.col("b.key"))
                   & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance)
                   & (~F.col("a.own") | (F.col("a.node") < F.col("b.node")))).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    return pairs.unionByName(_links_by_balls(
        asking.join(full, ["seg", "key"], "left_semi").select("node", "fp").distinct(), distance))


def _links_by_balls(nodes: DataFrame, distance: int) -> DataFrame:
    """Links of all nodes whose fingerprints have a common point half way.

    Two fingerprints are at ``distance`` or fewer bits exactly if the ball of half
    the distance, rounded up, around one meets that of the rest around the other.
    """
    def points(radius: int) -> DataFrame:
        masks = F.array(*[F.lit(_signed(m)) for m in _masks(BITS, radius)])
        return nodes.select("node", F.explode(
            F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))

    inner = points(distance // 2)
    least = inner.groupBy("point").agg(F.min("node").alias("m"))
    inner_links = inner.join(least, "point").where("node <> m").select(
        F.col("node").alias("a"), F.col("m").alias("b"))
    if distance % 2 == 0:
        return inner_links
    return inner_links.unionByName(
        points(distance // 2 + 1).join(least, "point").where("node <> m").select(
            F.col("node").alias("a"), F.col("m").alias("b")))


def linked(docs: DataFrame, distance: int = 4, words_in: int = 4, seed: int = 42,
           segments: int | None = None, doc_id: str = "doc_id",
           text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints (doc_id, fp) of all rows, the node of each fingerprint, and links (a, b) of nodes.

    A node is the smallest id of its fingerprint. By default three segments are used up to
    2^26 different fingerprints and two beyond, so that buckets stay small; both give the
    same classes.
    """
    prints = staged(fingerprints(docs, words_in, seed, doc_id, text), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(
        F.min(F.coalesce(F.col(doc_id), F.lit(NULL_ID))).alias("node")), "nodes")
    if segments is None:
        segments = 3 if nodes.count() <= 1 << 26 else 2
    return prints, nodes, links(nodes, distance, segments)


def _classes(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(fp, component): the smallest node that each fingerprint reaches over the links ``found``."""
    return staged(nodes.join(components(found), "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component")), "classes")


def near_duplicates(docs: DataFrame, distance: int = 4, words_in: int = 4, seed: int = 42,
                    segments: int | None = None, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links.
    """
    prints, nodes, found = linked(docs, distance, words_in, seed, segments, doc_id, text)
    return prints.join(_classes(nodes, found), "fp").select(
        doc_id, "fp", F.when(F.col("component") != NULL_ID, F.col("component"))
        .alias("component_id"))


def near_pairs(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ids for an operator that compares them, in two tables.

    First each document with the first one of its class, then all that is linked directly:
    fingerprints that are near each other, and documents of one fingerprint with the first
    of them. No id is ``NULL_ID``.
    """
    prints, nodes, found = linked(docs, **options)
    found = staged(found.distinct(), "links_of_fingerprints")
    own = F.coalesce(F.col(options.get("doc_id", "doc_id")).cast("long"), F.lit(NULL_ID))
    held = prints.select(own.alias("a"), "fp")
    firsts = held.join(_classes(nodes, found), "fp").select("a", F.col("component").cast("long").alias("b"))
    direct = held.join(nodes, "fp").select("a", F.col("node").cast("long").alias("b")).unionByName(
        found.select(F.col("a").cast("long"), F.col("b").cast("long")))
    return tuple(x.where("a <> b").distinct() for x in (firsts, direct))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose id is the smallest of its class; rows with one id are one document."""
    found = near_duplicates(docs, **options)
    doc_id = options.get("doc_id", "doc_id")
    lost = staged(found.where(~F.col(doc_id).eqNullSafe(F.col("component_id")))
                  .select(F.coalesce(doc_id, F.lit(NULL_ID)).alias("_lost")).distinct(), "lost")
    return docs.join(lost, F.coalesce(docs[doc_id], F.lit(NULL_ID)) == lost["_lost"], "left_anti")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
