"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.sources.scratch import materialise


class Links:
    """Union-find over places."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's links as a forest of stars."""
    for batch in batches:
        values, at = np.unique(np.concatenate([batch.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        found = Links(len(values))
        for i, j in zip(at[: batch.num_rows].tolist(), at[batch.num_rows :].tolist()):
            found.join(i, j)
        pairs = np.array([(i, r) for i in range(len(values)) if (r := found.root(i)) != i], "int64").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(values[pairs[:, 0]]), pa.array(values[pairs[:, 1]])], ["a", "b"])


def _settled(stars: DataFrame) -> bool:
    """Whether each a of stars (a, b) has one b, which is nobody's a: then all components are stars."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")), F.struct(F.col("b").alias("node"), F.lit(0).alias("under"), F.lit(1).alias("over")))
    nodes = stars.select(F.explode(ends).alias("e")).groupBy("e.node").agg((F.sum("e.under") + F.max("e.over")).alias("n"))
    return nodes.where("n > 1").agg(F.count("*")).first()[0] == 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b, longs) that isn't its component's smallest, and that smallest.

    Star contractions: every node links its larger neighbours, then its smaller ones, to the smallest of all, until
    all are stars. The tables between keep all links, and their number doesn't grow.
    """
    order = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    stars = materialise(order(edges.mapInArrow(_fewer, "a long, b long")), "edges")
    while not _settled(stars):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(order(large), "large")
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "small_least")
        small = large.join(least, "a").select("b", "m").where("b != m").unionByName(least.select(F.col("a").alias("b"), "m"))
        stars = materialise(order(small.select(F.col("b").alias("a"), F.col("m").alias("b"))), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
