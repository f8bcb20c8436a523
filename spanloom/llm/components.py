"""Connected components of a link table, by alternating star contractions.

Each round hangs the neighbours of every node below its smallest neighbour
(large star), then does the same among the smaller neighbours only (small star).
The links turn into stars around the smallest node of each component in a
logarithmic number of rounds. Every round is a written table: executors can be
lost, and the plan does not grow. Nothing but counts reaches the driver.
"""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import staged


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within one batch, links that close a circle are not needed; stars are left."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        found = [(x, root(x)) for x in list(parent)]
        found = [(x, y) for x, y in found if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()),
                                          pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of a link (a, b) between different nodes.

    ``component`` is the smallest node that can be reached. Nodes are longs.
    """
    thin = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b") \
        .mapInArrow(_thin, "a long, b long")
    edges = staged(thin.where("a <> b").distinct(), "links")     # a is the larger one
    seen = None
    while True:
        sizes = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sizes[0] == 0 or sizes == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = sizes
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = staged(edges.join(least, edges["b"] == least["u"])
                       .select(F.col("a"), F.col("m").alias("b")).distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        edges = staged(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
