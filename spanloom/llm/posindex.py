"""Benchmark decontamination with a positional inverted index.

The corpus is indexed in segments, each some millions of tokens of one task. All
tokens of a segment have addresses, counted through its documents with a hole
between two of them, so that no phrase runs over an end. The index is a written
table of postings (segment, term, count, addresses), sorted by term inside a
segment, and of document entries (term null) with the addresses where they begin.

A search cuts the items into windows, counts the wanted terms over all segments, and
orders the terms of each window by these counts; all of that are tables. A window
goes to the segments that hold its rarest term, and to no others, where it meets the
postings of wanted terms. The offset-adjusted address lists are intersected from the
rarest term on, until nothing is left. With ``slop`` a term may be that many words
from its place: proximity. Windows are divided into blocks of bounded size, and a
task has one segment and one block; the driver knows the number of blocks only.

Rows: null and empty texts have no words; each row of the corpus is an entry of
its own, whatever its id; items without words match nothing; rows of an item that
share an id are one item; an item without an id marks words but is not listed.
Empty tables give empty results. Extra columns are not read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanloom.llm.common import NULL_ID, staged

#: Bytes of words: digits, letters (lowered) and all of other alphabets; the rest are gaps.
WORD_BYTES = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128
                   else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: Tokens after which a task closes a segment.
SEGMENT_TOKENS = 1 << 20
#: Bytes of the windows of a block.
BLOCK_BYTES = 1 << 23
#: Windows of a batch that leaves the task.
CUT_ROWS = 10_000

INDEX_SCHEMA = ("segment long, term binary, n long, addresses binary, "
                "ids array<long>, starts array<long>, lengths array<long>")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


class _Segment:
    def __init__(self):
        self.terms, self.codes, self.at = _Terms(), [], 0
        self.ids, self.starts, self.lengths = [], [], []

    def add(self, doc_id: int | None, text: str | None) -> None:
        own = words(text)
        self.ids.append(doc_id)
        self.starts.append(self.at)
        self.lengths.append(len(own))
        self.codes.append(np.fromiter(map(self.terms.__getitem__, own), np.int32, len(own)))
        self.at += len(own) + 1

    def batches(self, segment: int, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(self.codes)
        starts, lengths = np.array(self.starts), np.array(self.lengths)
        places = np.arange(len(codes), dtype=np.int32) + np.repeat(
            np.arange(len(lengths), dtype=np.int32), lengths)
        order = np.argsort(codes, kind="stable")
        places, counts = places[order], np.bincount(codes, minlength=len(self.terms))
        ends = np.cumsum(counts)
        terms = list(self.terms)
        empty = pa.array([None], pa.list_(pa.int64()))
        yield _batch([segment], [None], [len(self.ids)], [None],
                     pa.array([self.ids], empty.type), pa.array([starts], empty.type),
                     pa.array([lengths], empty.type))
        by_name = sorted(range(len(terms)), key=terms.__getitem__)
        for i in range(0, len(terms), rows):
            part = by_name[i:i + rows]
            none = pa.nulls(len(part), empty.type)
            yield _batch([segment] * len(part), [terms[k] for k in part], counts[part],
                         [places[ends[k] - counts[k]:ends[k]].tobytes() for k in part],
                         none, none, none)


def _batch(segment, term, n, addresses, *lists) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(segment, pa.int64()), pa.array(term, pa.binary()), pa.array(n, pa.int64()),
         pa.array(addresses, pa.binary()), *lists],
        ["segment", "term", "n", "addresses", "ids", "starts", "lengths"])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The written index of all tokens of ``docs``; no shuffle is needed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        name, part = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                part.add(i, x.as_py())
                if part.at >= segment_tokens:
                    yield from part.batches(name)
                    name, part = name + 1, _Segment()
        if part.ids:
            yield from part.batches(name)
        pa.default_memory_pool().release_unused()        # the worker goes on to other stages

    return staged(docs.select(F.col(doc_id).cast("long"), F.col(text))
                  .mapInArrow(run, INDEX_SCHEMA), "positional_index")


def documents(index: DataFrame) -> DataFrame:
    """(segment, place, doc_id, n_words) of every indexed row."""
    return index.where(F.col("term").isNull()).select(
        "segment", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "x")).select(
        "segment", "place", F.col("x.ids").alias("doc_id"), F.col("x.lengths").alias("n_words"))


def _cut(size: int):
    """Windows of ``size`` consecutive words; an item of fewer words is one window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1)):
                own = words(text.as_py())
                for first in range(0, max(1, len(own) - size + 1) if own else 0, CUT_ROWS):
                    last = min(first + CUT_ROWS, max(1, len(own) - size + 1))
                    cut = [own[i:i + size] for i in range(first, last)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(cut), pa.int64()), pa.array(cut, pa.list_(pa.binary()))],
                        ["item_id", "words"])
    return run


def _occurrences(terms: list[int], places: list[int], postings: dict[int, np.ndarray], slop: int,
                 starts: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
    """Addresses at which a phrase begins, by its rarest term, which comes first."""
    found = low = high = None
    for term, place in zip(terms, places):
        at = postings.get(term)
        if at is None or (found is not None and not len(found)):
            return None
        if found is None:
            found = at - place
            if slop:                         # the bounds of the documents that hold the rarest term
                inside = np.searchsorted(starts, at, "right") - 1
                low, high = starts[inside], starts[inside] + lengths[inside] - 1
            continue
        # the term at its place in the phrase, or up to ``slop`` words from it
        first = last = found + place
        if slop:
            first, last = np.maximum(first - slop, low), np.minimum(last + slop, high)
        next_ = np.searchsorted(at, first)
        good = (next_ < len(at)) & (at[np.minimum(next_, len(at) - 1)] <= last)
        found = found[good]
        if slop:
            low, high = low[good], high[good]
    return found


def _search(slop: int):
    """Spans of one segment: its wanted postings and document entry meet the phrases of a block."""
    def run(rows: pa.Table, phrases: pa.Table) -> pa.Table:
        spans: dict[object, list] = {}
        if phrases.num_rows:
            terms = rows.column("id").to_pylist()
            entry = rows.slice(terms.index(None), 1).to_pylist()[0]
            starts, lengths = np.array(entry["starts"]), np.array(entry["lengths"])
            postings = {t: np.frombuffer(x.as_buffer(), np.int32)
                        for t, x in zip(terms, rows.column("addresses")) if t is not None}
            for item, order in zip(phrases.column("item_id").to_pylist(), phrases.column("terms")):
                order = order.as_py()
                places = [x["place"] for x in order]
                found = _occurrences([x["id"] for x in order], places, postings, slop, starts, lengths)
                if found is not None and len(found):
                    spans.setdefault(item, []).append(
                        np.stack([found - slop, found + len(places) + slop, found + places[0]], 1))
        out = []
        for item, parts in spans.items():
            edges = np.concatenate(parts)
            # a phrase with ``slop`` may begin or end outside its document; its rarest term does not
            inside = np.searchsorted(starts, edges[:, 2], "right") - 1
            low = np.maximum(edges[:, 0], starts[inside])
            high = np.minimum(edges[:, 1], starts[inside] + lengths[inside])
            order = np.lexsort((high, low, inside))
            inside, low, high = inside[order], low[order], high[order]
            reach = np.maximum.accumulate(high)              # runs of overlapping occurrences
            first = np.r_[True, (low[1:] > reach[:-1]) | (inside[1:] != inside[:-1])]
            last = np.r_[np.nonzero(first)[0][1:] - 1, len(low) - 1]
            out += zip([item] * len(last), inside[first].tolist(),
                       (low[first] - starts[inside[first]]).tolist(),
                       (reach[last] - starts[inside[first]]).tolist())
        pa.default_memory_pool().release_unused()
        items, places, begins, ends = zip(*out) if out else ((), (), (), ())
        return pa.table({"segment": pa.array([entry["segment"]] * len(out) if out else [], pa.int64()),
                         "place": pa.array(places, pa.int32()),
                         "item_id": pa.array(items, pa.int64()),
                         "begin": pa.array(begins, pa.int64()), "end": pa.array(ends, pa.int64())})
    return run


def phrases(index: DataFrame, items: DataFrame, window: int, item_id: str, text: str,
            block_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """The query set as tables, and the number of its blocks.

    First ``wanted`` (term, id), the different terms. Second the windows that the index
    can hold, all their terms being in it: (block, item_id, rarest, terms), where
    ``terms`` has id and place of each term, rarest first. A block has about
    ``block_bytes``.
    """
    pieces = staged(items.select(F.col(item_id).cast("long"), F.col(text))
                    .mapInArrow(_cut(window), "item_id long, words array<binary>").distinct(), "windows")
    size = F.lit(64) + F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))
    n, total = pieces.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = max(1, min(n, -(-total // block_bytes)))
    terms = pieces.select(F.explode("words").alias("term")).distinct()
    wanted = staged(terms.withColumn("id", F.monotonically_increasing_id()), "wanted_terms")
    counts = staged(_postings(index, wanted).groupBy("id").agg(F.sum("n").alias("n")), "term_counts")
    places = pieces.withColumn("piece", F.monotonically_increasing_id()).select(
        "piece", "item_id", F.size("words").alias("length"), F.posexplode("words").alias("place", "term"))
    ranked = places.join(wanted, "term").join(counts, "id").groupBy("piece", "item_id", "length").agg(
        F.array_sort(F.collect_list(F.struct("n", "place", "id"))).alias("x")).where(F.size("x") == F.col("length"))
    found = ranked.select(
        F.pmod("piece", F.lit(blocks)).cast("int").alias("block"), "item_id",
        F.col("x")[0]["id"].alias("rarest"),
        F.transform("x", lambda t: F.struct(t["id"].alias("id"), t["place"].alias("place"))).alias("terms"))
    return wanted, staged(found, "phrases"), blocks


def _postings(index: DataFrame, wanted: DataFrame) -> DataFrame:
    return index.where(F.col("term").isNotNull()).join(wanted, "term")


def search(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 0,
           item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(segment, place, item_id, begin, end): word spans that hold windows of an item.

    Overlapping occurrences of one item in one document are one span. ``slop`` 0
    asks for exact phrases; else every term lies up to ``slop`` words from its place
    beside the rarest term, and a span reaches as far.
    """
    wanted, windows, blocks = phrases(index, items, window, item_id, text, block_bytes)
    postings = _postings(index, wanted)
    places = postings.select(F.col("segment").alias("own"), F.col("id").alias("rarest"))
    work = windows.join(places, "rarest").select("own", F.col("block").alias("part"), "item_id", "terms")
    if blocks == 1:
        held = postings.withColumn("block", F.lit(0))
    else:
        asked = staged(windows.select("block", F.explode("terms.id").alias("id")).distinct(), "block_terms")
        held = postings.join(asked, "id")
    none = F.lit(None).cast("array<long>")
    entries = index.where(F.col("term").isNull()).select(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("addresses"), "starts", "lengths")
    rows = held.select("segment", "block", "id", "addresses", none.alias("starts"),
                       none.alias("lengths")).unionByName(entries)
    return rows.groupBy("segment", "block").cogroup(work.groupBy("own", "part")).applyInArrow(
        _search(slop), "segment long, place int, item_id long, begin long, end long")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, item_ids (sorted as strings)."""
    index = build_index(docs, doc_id, text)
    spans = staged(search(index, items, window, slop), "spans")
    row = Window.partitionBy("segment", "place").orderBy("begin", "end")
    reach = F.max("end").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(reach, F.lit(0))))
    hits = spans.withColumn("new", new).groupBy("segment", "place").agg(
        F.sum("new").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return documents(index).join(hits, ["segment", "place"], "left").select(
        F.col("doc_id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """Rows of ``docs`` without a window of an item; rows with one id go together."""
    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID))
    hit = staged(contamination(docs, items, window, 0, doc_id, text).where("n_hit > 0")
                 .select(own.alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, F.coalesce(docs[doc_id].cast("long"), F.lit(NULL_ID)) == hit["_hit"],
                     "left_anti")
