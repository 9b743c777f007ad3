"""Exact top-k search by inner product with a KD-tree per shard.

Vectors are dealt to shards by space: down a top tree of median splits, made of a bounded sample (TOP vectors, those with
the smallest hashes), to at most LEAVES leaves. A leaf of more than SHARD vectors is cut into pieces by a hash of the id, so
a vector that is repeated often fills no task. Each shard's tree is built once, by median splits of the widest side with
tight bounding boxes, and written; its vectors are not moved again, and only queries are sent to it.

Every query first searches its own shard. Its kth result then meets the root boxes of all shards, a row each, and the query
goes on to those only whose box allows as much. In a shard it goes through the tree best first, by the largest inner
product that a box allows, and stops where that can't reach the kth result known so far. Batches of queries get the bounds
of all nodes by one product of matrices, which costs less than bounds one by one as they are reached.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; of two vectors of
different lengths the shorter counts as filled up with zeros; ties go to the smaller id; repeated rows of an id and vector
are one query and as many candidates, and an id with several vectors is a query for each, whose results are taken
together; a query's own id is never among its results; an inner product that a long can't hold ends the query with an
error, as do components beyond it; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.blocks import ROWS, state_of, table_of
from framelake.llm.common import bucketed, materialise, release, trimmed

SHARD, LITTLE, LEAF = 65_536, 2048, 64
#: Vectors that make the top tree, and its leaves at most.
TOP, LEAVES = 8192, 512
#: Queries whose bounds are made together.
ASKED = 512
_FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Nodes as arrays: bounding boxes, smallest id, and a child pair or a slice of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(ids))
        self.low, self.high, self.least, self.child, self.span = [], [], [], [], []
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self._grow(0, len(ids))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.ids, self.vectors = ids[self.order], vectors[self.order]

    def _grow(self, start: int, end: int) -> int:
        rows = self.order[start:end]
        here = self.vectors[rows]
        low, high, node = here.min(axis=0), here.max(axis=0), len(self.least)
        self.low.append(low), self.high.append(high), self.least.append(int(self.ids[rows].min())), self.child.append(None), self.span.append((start, end))
        axis = int((high - low).argmax())
        if end - start > self.leaf and high[axis] > low[axis]:
            half = (end - start) // 2
            exact = here.dtype == object  # whole numbers of any size
            self.order[start:end] = rows[np.argsort(here[:, axis]) if exact else np.argpartition(here[:, axis], half)]
            self.child[node] = (self._grow(start, start + half), self._grow(start + half, end))
        return node

    def state(self) -> dict:
        """What of() makes the tree of again."""
        return {c: getattr(self, c) for c in ("low", "high", "least", "child", "span", "ids", "vectors")}

    @classmethod
    def of(cls, state: dict) -> Tree:
        tree = cls.__new__(cls)
        tree.__dict__.update(state)
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each node's box allows each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int, kth: tuple[float, int] | None) -> list[tuple[float, int]]:
        """The k best (score, -id); those worse than kth, a (score, -id) known from elsewhere, may lack."""
        best: list[tuple[float, int]] = []
        floor = kth or (-np.inf, 0)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            worst = max(best[0], floor) if len(best) == k else floor
            if -bound < worst[0]:
                break
            if -bound == worst[0] and -self.least[node] < worst[1]:
                continue
            if self.child[node]:
                for c in self.child[node]:
                    if bounds[c] >= worst[0]:
                        heapq.heappush(queue, (-bounds[c], c))
                continue
            start, end = self.span[node]
            scores = self.vectors[start:end] @ query
            for i in np.flatnonzero(scores >= worst[0]):
                hit = (scores[i], -int(self.ids[start + i]))
                if -hit[1] == query_id or hit < floor:
                    continue
                if len(best) < k:
                    heapq.heappush(best, hit)
                elif hit > best[0]:
                    heapq.heapreplace(best, hit)
        return best


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of longs as rows, filled up with zeros to the longest."""
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), int(lengths.max(initial=0))), "int64")
    out[np.arange(out.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


class TopTree:
    """Median splits of a sample's widest sides: which leaf a vector belongs to."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.axis, self.cut, self.low, self.high, self.leaves = [], [], [], [], 0
        self._grow(sample, leaves)

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        """A node's number, or -1 less a leaf's."""
        spread = sample.max(axis=0).astype("float64") - sample.min(axis=0) if sample.size else np.zeros(1)
        if leaves < 2 or len(sample) < 4 or not spread.max() > 0:
            self.leaves += 1
            return -self.leaves
        axis, node = int(spread.argmax()), len(self.axis)
        values = np.sort(sample[:, axis])
        cut = values[len(values) // 2]
        cut = cut if cut > values[0] else values[values > values[0]][0]
        for held, v in ((self.axis, axis), (self.cut, cut), (self.low, 0), (self.high, 0)):
            held.append(v)
        below = sample[:, axis] < cut
        self.low[node] = self._grow(sample[below], leaves // 2)
        self.high[node] = self._grow(sample[~below], leaves - leaves // 2)
        return node

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.zeros(len(vectors), "int64") if self.axis else np.full(len(vectors), -1)
        axis, low, high, cut = np.array(self.axis, "int64"), np.array(self.low), np.array(self.high), np.array(self.cut)
        while len(left := np.flatnonzero(at >= 0)):
            node = at[left]
            at[left] = np.where(vectors[left, axis[node]] < cut[node], low[node], high[node])
        return -at - 1


def _kind(most: int, width: int) -> str:
    """The type in which all inner products are exact: floats, longs, or whole numbers of any size."""
    reach = most * most * width * 1.001
    return "float64" if reach < 2**53 else "int64" if reach < 2**63 else "object"


def dealt(rows: DataFrame, shard: int, width: int) -> DataFrame:
    """rows (id, v, query) with their shard."""
    n = rows.count()
    few = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = min(LEAVES, max(-(-n // shard), min(few, n // LITTLE), 1))
    sample = rows.select("v").orderBy(F.xxhash64("id"), "v").limit(TOP).collect() if leaves > 1 else []
    held = np.array([list(r.v) + [0] * (width - len(r.v)) for r in sample], object if any(abs(x) >= 2**62 for r in sample for x in r.v) else "int64").reshape(len(sample), width)
    top = TopTree(held, leaves)

    @trimmed
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = top.leaf_of(_wide(_matrix(batch.column("v")), width))
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype("int64")), *batch.columns], ["leaf", *batch.schema.names])

    found = materialise(rows.mapInArrow(find, "leaf long, id long, v array<long>, query boolean"), "leaves")
    pieces = found.groupBy("leaf").agg(F.ceil(F.count("*") / shard).alias("pieces"))  # LEAVES rows at most
    number = F.col("leaf") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("pieces"))
    return found.join(F.broadcast(pieces), "leaf").select(number.alias("shard"), "id", "v", "query")


def built_trees(vectors: DataFrame, width: int, kind: str) -> DataFrame:
    """A written tree for each shard of vectors (shard, id, v), and its root box as the shard's list."""

    def build(rows: pa.Table) -> pa.Table:
        tree = Tree(rows["id"].to_numpy(), _wide(_matrix(rows["v"].combine_chunks()), width).astype(kind))
        out = table_of(rows["shard"][0].as_py(), iter([(0, {"low": tree.low[0], "high": tree.high[0], "least": tree.least[0]})]), tree.state())
        release()
        return out

    few = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(vectors.select("shard", "id", "v").groupBy("shard").applyInArrow(build, ROWS), few, "block")


def _search(k: int, width: int, kind: str):
    """The best of a shard's tree for the queries (shard, id, v, kth_score, kth_id) that came to it."""

    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if trees.num_rows and queries.num_rows:
            tree, v = Tree.of(state_of(trees)), _wide(_matrix(queries["v"].combine_chunks()), width).astype(kind)
            known = list(zip(*(queries[c].to_pylist() for c in ("id", "kth_score", "kth_id"))))
            for at in range(0, len(known), ASKED):
                part = v[at : at + ASKED]
                for (q, score, i), own, b in zip(known[at:], part, tree.bounds(part)):
                    for s, hit in tree.search(q, own, b, k, None if score is None else (score, -i)):
                        for column, x in zip(out, (q, -hit, int(s))):
                            column.append(x)
        release()
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return search


def routed(asked: DataFrame, boxes: list[tuple[int, dict]], width: int, kind: str) -> DataFrame:
    """asked (shard, id, v, kth_score, kth_id) for each other shard whose box allows the kth score."""
    shards = np.array([b for b, _ in boxes], "int64")
    low, high = (np.array([x[c] for _, x in boxes], kind).reshape(len(boxes), width) for c in ("low", "high"))

    @trimmed
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ASKED):
                rows = batch.slice(at, ASKED)
                v = _wide(_matrix(rows.column("v")), width).astype(kind)
                bounds = np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T
                kth = rows.column("kth_score").to_pylist()
                open_ = np.array([[True] * len(shards) if s is None else list(b >= s) for s, b in zip(kth, bounds)], bool).reshape(len(kth), len(shards))
                open_ &= rows.column("shard").to_numpy()[:, None] != shards
                i, j = np.nonzero(open_)
                taken = rows.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([pa.array(shards[j]), *taken.columns[1:]], rows.schema.names)

    return asked.mapInArrow(route, "shard long, id long, v array<long>, kth_score long, kth_id long")


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a long; null if a component is null or not finite.

    A component that a long can't hold is an error.
    """
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)) & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.when(F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0**63, F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for a long")))))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows of vectors (vec_id, v) for those where queries holds."""
    rows = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("id"), "v", F.coalesce(queries, F.lit(False)).alias("query"))
    rows = materialise(rows, "vectors")
    width, high, low = rows.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    width, most = width or 1, max(abs(high or 0), abs(low or 0))
    kind = _kind(most, width)
    vectors = dealt(rows, shard, width)
    trees = built_trees(vectors, width, kind)
    none = F.lit(None).cast("long")
    asked = materialise(vectors.where("query").select("shard", "id", "v", none.alias("kth_score"), none.alias("kth_id")).distinct(), "asked")

    def run(q: DataFrame) -> DataFrame:
        return trees.select("block", "piece", "data").groupBy("block").cogroup(q.groupBy("shard")).applyInArrow(_search(k, width, kind), _FOUND)

    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    found = home = materialise(run(asked), "home")
    boxes = sorted(((r["block"], pickle.loads(r["data"])) for r in trees.where("bucket is not null").select("block", "data").collect()), key=lambda b: b[0])  # a row for each shard
    if len(boxes) > 1:
        kth = best(home).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth_score"), F.col("vec_id").alias("kth_id"))
        known = asked.drop("kth_score", "kth_id").join(kth, "id", "left").select(asked.columns)
        found = home.unionByName(run(routed(known, boxes, width, kind)))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """top_k of the quantised column embedding; queries are the rows whose vec_id is divisible by every."""
    return top_k(embeddings.select("vec_id", quantised(F.col("embedding")).alias("v")), F.col("vec_id") % every == 0, k)

