"""Product-quantised codes of vectors, by Lloyd rounds over two trees.

A vector is cut into equal parts, and each part position has a codebook. In every
round each Arrow batch of parts is put into a tree by halving it at its widest
dimension, and the entries of the codebook into another. The trees are walked down
together: a pair of nodes goes when even its smallest distance is above the largest
distance of another pair of the same node of parts. A node of parts with one entry
left is assigned as a whole, with its cached sum and count. What is uncertain at the
leaves is compared in integers. All distances are integers, so results are exact, and
sums and counts by part and entry are all that leaves a task.

Rows: vectors that are null or hold null or non-finite components are dropped. Null
labels are one group. A null id counts as the largest; repeated rows are rows of their
own, and equal ids are ordered by their components.
With fewer vectors than entries the codebook has one entry a vector. A table without
vectors gives no row. Vectors of different lengths, a length that the number of parts
does not divide, and components beyond ``LARGEST`` / 256 raise a ValueError. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import staged

#: Integer components stay below this, so that no squared distance or sum leaves a long.
LARGEST = 1 << 24
LEAF = 32
#: Pairs of a leaf and an entry that are compared at once.
PAIRS = 1 << 11


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
             label: str = "label", scale: int = 256) -> DataFrame:
    """(vec_id, label, q): components as integers, of the vectors that are whole."""
    x = F.col(embedding)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(x.isNotNull()).where(whole).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("q"))


# ---- the trees ---------------------------------------------------------------

class Tree:
    """Levels of boxes over ``points`` (n, d); a level has twice the nodes of the one above.

    ``rows`` (leaf, m) says which points a leaf holds; ``real`` which of them are not
    there to fill it up.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        depth = max(0, (-(-len(points) // leaf) - 1).bit_length())
        size = -(-len(points) // (1 << depth))
        rows = np.minimum(np.arange(size << depth), len(points) - 1)[None]
        real = (np.arange(size << depth) < len(points))[None]
        for _ in range(depth):
            own = points[rows]
            wide = (own.max(axis=1) - own.min(axis=1)).argmax(axis=1)
            by = np.take_along_axis(own, wide[:, None, None], axis=2)[:, :, 0].argsort(axis=1, kind="stable")
            rows, real = (np.take_along_axis(a, by, axis=1).reshape(2 * len(a), -1) for a in (rows, real))
        self.rows, self.real = rows, real
        own = points[rows]
        level = own.min(axis=1), own.max(axis=1), (own * real[:, :, None]).sum(axis=1), real.sum(axis=1)
        self.levels = [level]
        for _ in range(depth):
            low, high, total, count = level
            level = (np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]),
                     total[::2] + total[1::2], count[::2] + count[1::2])
            self.levels.insert(0, level)

    @property
    def depth(self) -> int:
        return len(self.levels) - 1


def _bounds(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest squared distance of the boxes ``i`` of ``a`` and ``j`` of ``b``."""
    up, down = a[1][i] - b[0][j], b[1][j] - a[0][i]
    gap = np.maximum(0, np.maximum(-up, -down))
    reach = np.maximum(up, down)
    return (gap * gap).sum(axis=1), (reach * reach).sum(axis=1)


def _starts(i: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, i[1:] != i[:-1]])


class Assigned:
    """Entries of all points, sums and counts by entry, and how many distances were taken."""

    def __init__(self, tree: Tree, points: np.ndarray, entries: np.ndarray):
        k, self.taken = len(entries), 0
        self.code = np.zeros(len(points), np.int64)
        self.total = np.zeros((k, points.shape[1]), np.int64)
        self.count = np.zeros(k, np.int64)
        # an entry equal to an earlier one is never the nearest
        first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        books = Tree(entries[first], 1)
        i = j = np.zeros(1, np.int64)                        # pairs of nodes, by the node of parts
        at = below = 0
        while True:
            a, b = tree.levels[at], books.levels[below]
            real = (a[3][i] > 0) & (b[3][j] > 0)
            i, j = i[real], j[real]
            if not len(i):
                return
            low, high = _bounds(a, b, i, j)
            here = _starts(i)
            least = np.repeat(np.minimum.reduceat(high, here), np.diff(np.r_[here, len(i)]))
            i, j = i[low <= least], j[low <= least]
            if below == books.depth:                         # an entry each
                alone = np.bincount(i, minlength=len(a[3]))[i] == 1
                self._whole(tree, at, i[alone], first[books.rows[j[alone], 0]], a)
                i, j = i[~alone], j[~alone]
            if not len(i):
                return
            if at == tree.depth and below == books.depth:
                return self._leaves(tree, points, entries, i, first[books.rows[j, 0]])
            if below < books.depth:
                i, j, below = np.repeat(i, 2), np.stack([2 * j, 2 * j + 1], 1).ravel(), below + 1
            if at < tree.depth:
                i, j, at = np.r_[2 * i, 2 * i + 1], np.r_[j, j], at + 1
                by = np.lexsort((j, i))
                i, j = i[by], j[by]

    def _whole(self, tree: Tree, at: int, i: np.ndarray, entry: np.ndarray, level: tuple) -> None:
        np.add.at(self.total, entry, level[2][i])
        np.add.at(self.count, entry, level[3][i])
        wide = 1 << (tree.depth - at)
        leaves = (i[:, None] * wide + np.arange(wide)).ravel()
        rows, real = tree.rows[leaves], tree.real[leaves]
        self.code[rows[real]] = np.broadcast_to(np.repeat(entry, wide)[:, None], rows.shape)[real]

    def _leaves(self, tree: Tree, points: np.ndarray, entries: np.ndarray, i: np.ndarray,
                entry: np.ndarray) -> None:
        by = np.lexsort((entry, i))                          # the smaller entry wins a tie
        i, entry = i[by], entry[by]
        here = _starts(i)
        d = np.empty((len(i), tree.rows.shape[1]), np.int64)
        for x in range(0, len(i), PAIRS):
            part = slice(x, x + PAIRS)
            apart = points[tree.rows[i[part]]] - entries[entry[part]][:, None]
            d[part] = np.einsum("pmc,pmc->pm", apart, apart)
        self.taken = d.size
        least = np.repeat(np.minimum.reduceat(d, here, axis=0), np.diff(np.r_[here, len(i)]), axis=0)
        best = np.minimum.reduceat(np.where(d == least, entry[:, None], len(entries)), here, axis=0)
        leaves = i[here]
        real = tree.real[leaves]
        rows, best = tree.rows[leaves][real], best[real]
        self.code[rows] = best
        np.add.at(self.total, best, points[rows])
        np.add.at(self.count, best, 1)


# ---- rounds over the table -----------------------------------------------------

def _parts(column: pa.Array, parts: int, length: int) -> np.ndarray:
    """(part, row, component) of one batch."""
    if len(column.flatten()) != len(column) * length or set(column.value_lengths().to_pylist()) - {length}:
        raise ValueError("vectors of different lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(flat) and max(flat.max(), -flat.min()) >= LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // 256}")
    return flat.reshape(len(column), parts, length // parts).transpose(1, 0, 2)


def _sums(books: list[np.ndarray], length: int):
    """(part, entry, n, s0, s1, …) of each batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for p, points in enumerate(_parts(batch.column(0), len(books), length)):
                points = np.ascontiguousarray(points)
                got = Assigned(Tree(points, LEAF), points, books[p])
                used = np.flatnonzero(got.count)
                out.append(np.c_[np.full(len(used), p), used, got.count[used], got.total[used]])
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], ["part", "entry", "n"] + [
                f"s{i}" for i in range(rows.shape[1] - 3)])
    return run


def _codes(books: list[np.ndarray], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            error, codes = np.zeros(batch.num_rows, np.int64), []
            for p, points in enumerate(_parts(batch.column(2), len(books), length)):
                points = np.ascontiguousarray(points)
                code = Assigned(Tree(points, LEAF), points, books[p]).code
                error += ((points - books[p][code]) ** 2).sum(axis=1)
                codes.append(code)
            table = np.stack(codes, 1).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(["".join(f"{c:02x}" for c in r) for r in table]),
                 pa.array(error)], ["vec_id", "label", "code", "error"])
    return run


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> list[np.ndarray]:
    """Codebooks by part position (entry, component) of ``rows`` (vec_id, label, q), not empty.

    The first ``entries`` vectors by id are where the codebooks start. At most ``parts`` x
    ``entries`` sums of a round come to the driver.
    """
    if entries > 256:
        raise ValueError("an index has two hexadecimal digits")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    length = len(start[0]["q"])
    if length % parts:
        raise ValueError(f"{length} components cannot be cut into {parts} equal parts")
    wide = length // parts
    if len({len(r["q"]) for r in start}) > 1:
        raise ValueError("vectors of different lengths")
    q = np.array([r["q"] for r in start], np.int64).reshape(len(start), parts, wide)
    books = [q[:, p].copy() for p in range(parts)]
    schema = ", ".join(f"{c} long" for c in ["part", "entry", "n", *(f"s{i}" for i in range(wide))])
    for _ in range(rounds if wide else 0):
        found = rows.select("q").mapInArrow(_sums(books, length), schema).groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(wide)]).collect()
        for r in found:
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(wide)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2,
             vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row for each whole vector.

    ``code`` has two hexadecimal digits for each part; ``error`` is the squared distance
    to the coded vector, ``label_error`` its sum over the rows with the same label.
    """
    rows = staged(integers(vectors, vec_id, embedding, label), "integers")
    of, name = rows.schema["vec_id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    schema = f"vec_id {of}, label {name}, code string, error long"
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame(
            [], schema + ", label_error long, codebooks_sha256 string")
    books = fit(rows, parts, entries, rounds)
    length = parts * books[0].shape[1]
    coded = staged(rows.select("vec_id", "label", "q").mapInArrow(_codes(books, length), schema), "codes")
    sums = coded.groupBy(F.col("label").alias("_of")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_of"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
