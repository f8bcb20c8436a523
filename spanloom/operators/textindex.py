"""Trigram postings over unit texts: substring conditions that do not read every unit.

Units are numbered by blocks of some 2^20 characters. For each trigram of the folded texts
(A-Z as a-z) and each block, one row lists the numbers of the units that hold it; a second
table says which document and position a number stands for. The lists are sorted by trigram
over all their files, so a query reads the row groups of its own trigrams. Of those the
rarest are intersected, rarest first, and what is left is verified with the condition itself.
Texts to look for with no run of three characters are looked for in all units.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.session import write_and_read

SIZE = 3
#: Trigrams of a query that are intersected; more would hardly leave fewer units.
INTERSECTED = 4
#: Up to so many documents are named one by one, which leaves out buckets and row groups.
NAMED = 100
#: Characters of units from which a block is full.
BLOCK_CHARS = 1 << 20
#: Blocks of a partition are numbered from its number times this.
BLOCKS = 1 << 32


LISTS = ("gram string, block long, n int, units array<int>, "
         "doc_ids array<string>, docs array<int>, positions array<int>")
_LIST = pa.list_(pa.int32())
_SCHEMA = pa.schema([("gram", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("units", _LIST),
                     ("doc_ids", pa.list_(pa.string())), ("docs", _LIST), ("positions", _LIST)])


def _grams_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Trigrams of the folded texts, where the list of each one ends, and all lists: numbers of texts, ascending."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points[(points >= 65) & (points <= 90)] += 32
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters, n = np.flatnonzero(seen), max(len(texts), 1)
    dense = (np.cumsum(seen) - 1)[points]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.maximum(sizes - (SIZE - 1), 0)                     # trigrams of each text
    own = np.repeat(np.arange(len(texts)), starts)
    at = np.arange(len(own)) + np.repeat(np.cumsum(sizes - starts) - (sizes - starts), starts)
    codes, grams = None, (dense[at] * len(letters) + dense[at + 1]) * len(letters) + dense[at + 2]
    if len(letters) ** SIZE * n >= 1 << 63:                        # too many letters to number the rows below
        codes, grams = np.unique(grams, return_inverse=True)
    held = np.sort(grams * n + own)
    held = held[np.diff(held, prepend=-1) > 0]
    grams = held // n
    firsts = np.flatnonzero(np.diff(grams, prepend=-1))
    found = grams[firsts] if codes is None else codes[grams[firsts]]
    points = np.stack([found // len(letters) ** 2, found // len(letters) % len(letters), found % len(letters)], axis=1) \
        if len(found) else np.zeros((0, SIZE), np.int64)
    names = letters[points].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [names[i:i + SIZE] for i in range(0, len(names), SIZE)], np.append(firsts, len(held)), held - grams * n


def _block(number: int, doc_ids: list, positions: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of a block: a list of units for each trigram, and one row that says what the numbers stand for."""
    grams, ends, units = _grams_of(texts)
    named = list(dict.fromkeys(doc_ids))
    at = {d: i for i, d in enumerate(named)}
    rows, none = len(grams), pa.nulls
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(units, pa.int32()))
    return pa.RecordBatch.from_arrays([
        pa.array([*grams, None], pa.string()), pa.array([number] * (rows + 1), pa.int64()),
        pa.array([*np.diff(ends).tolist(), None], pa.int32()), pa.concat_arrays([lists, none(1, _LIST)]),
        pa.concat_arrays([none(rows, pa.list_(pa.string())), pa.array([named], pa.list_(pa.string()))]),
        pa.concat_arrays([none(rows, _LIST), pa.array([[at[d] for d in doc_ids]], _LIST)]),
        pa.concat_arrays([none(rows, _LIST), pa.array([positions], _LIST)])], schema=_SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks of a partition; units without a text have no trigrams."""
    number, chars = TaskContext.get().partitionId() * BLOCKS, 0
    columns: tuple[list, list, list] = [], [], []
    for batch in batches:
        for column, values in zip(columns, batch.columns):
            column += values.to_pylist()
        columns[2][len(columns[2]) - batch.num_rows:] = [x or "" for x in columns[2][len(columns[2]) - batch.num_rows:]]
        chars += sum(map(len, columns[2][len(columns[2]) - batch.num_rows:]))
        if chars >= BLOCK_CHARS:
            yield _block(number, *columns)
            number, chars, columns = number + 1, 0, ([], [], [])
    if columns[0]:
        yield _block(number, *columns)


def _literal_grams(literals: list[str]) -> list[str]:
    # only A-Z is folded, as in the texts
    folded = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in literals]
    return sorted({x[i:i + SIZE] for x in folded for i in range(len(x) - SIZE + 1)})


@dataclass
class TextIndex:
    lists: DataFrame        # gram, block, n, units (the numbers, in the block, of the n units that hold it)
    blocks: DataFrame       # block, doc_ids, and by the number of a unit: docs (place in doc_ids), positions
    grams: DataFrame        # gram, n (units that hold it)

    @staticmethod
    def build(units: DataFrame, folder: str) -> "TextIndex":
        """Postings of ``units`` (doc_id, position, unit_text), written below ``folder``.

        The lists are written before they are dealt out: the bounds of the ranges would
        make them a second time.
        """
        spark = units.sparkSession
        rows = write_and_read(units.select("doc_id", "position", "unit_text").mapInArrow(_blocks, LISTS),
                              "unsorted", folder)
        rows.where("gram IS NULL").select("block", "doc_ids", "docs", "positions").write.mode("error").parquet(
            f"{folder}/blocks")
        rows.where("gram IS NOT NULL").select("gram", "block", "n", "units").repartitionByRange(
            "gram", "block").sortWithinPartitions("gram", "block").write.mode("error").parquet(f"{folder}/lists")
        spark.read.parquet(f"{folder}/lists").groupBy("gram").agg(F.sum("n").alias("n")).repartitionByRange("gram") \
            .sortWithinPartitions("gram").write.mode("error").parquet(f"{folder}/grams")
        return TextIndex.load(spark, folder)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> "TextIndex":
        return TextIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("lists", "blocks", "grams")])

    @property
    def postings(self) -> DataFrame:
        """(gram, doc_id, places): positions of the units that hold a trigram, by document and block."""
        return self._named(self.lists, "gram")

    def _named(self, lists: DataFrame, *keep: str) -> DataFrame:
        """Documents and positions of the unit numbers in ``lists`` (block, units)."""
        held = lists.join(self.blocks, "block").select(*keep, "block", F.inline(F.transform("units", lambda u: F.struct(
            F.get("doc_ids", F.get("docs", u)).alias("doc_id"), F.get("positions", u).alias("place")))))
        return held.groupBy(*keep, "block", "doc_id").agg(F.collect_list("place").alias("places")).drop("block")

    def rarest(self, literals: list[str]) -> list[str] | None:
        """Trigrams to intersect, rarest first; none if they have none, None if one occurs nowhere."""
        asked = _literal_grams(literals)
        if not asked:
            return []
        counts = {r["gram"]: r["n"] for r in self.grams.where(F.col("gram").isin(*asked)).collect()}
        if len(counts) < len(asked):
            return None
        return sorted(asked, key=lambda g: (counts[g], g))[:INTERSECTED]

    def places(self, grams: list[str]) -> DataFrame:
        """(doc_id, places) of the units that hold all ``grams``, one row a document."""
        def of(gram: str, name: str) -> DataFrame:
            return self.lists.where(F.col("gram") == gram).select("block", F.col("units").alias(name))
        found = of(grams[0], "units")
        for g in grams[1:]:
            found = found.join(of(g, "_more"), "block").select(
                "block", F.array_intersect("units", "_more").alias("units")).where(F.size("units") > 0)
        return self._named(found).groupBy("doc_id").agg(
            F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))

    def narrowed(self, units: DataFrame, literals: list[str]) -> DataFrame:
        """Those of ``units`` that may hold all ``literals``; the caller verifies them."""
        grams = self.rarest(literals)
        if grams is None:
            return units.where(F.lit(False))
        if not grams:
            return units
        found = self.places(grams)
        few = [r["doc_id"] for r in found.select("doc_id").limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return units.where(F.col("doc_id").isin(*few) if few else F.lit(False))
        held = found.select("doc_id", F.col("places").alias("_places"))
        return units.join(held, "doc_id").where(F.array_contains("_places", F.col("position"))).drop("_places")


def literals_of_like(pattern: str) -> list[str]:
    """The literal runs of a pattern with live wildcards."""
    return [x for x in re.split("[%_]", pattern) if x]
