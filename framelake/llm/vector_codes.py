"""Vector codes: the parts of integer vectors named by the nearest entries of a codebook for each part, learnt by Lloyd rounds.

Rounds keep, for each block of vectors and each part, a heap for each entry. A heap holds the entry's parts by their slack,
the distance to the second nearest entry less that to the nearest (a lower less an upper bound), when both were last
measured; the entry's cumulative drift, its own moves and the largest of the others', is added to the key. After a move of
the entries only the parts whose key no longer exceeds the drift can belong elsewhere: they are popped and measured
against all entries, exactly, and pushed again. Sums change by what moves only. Heaps stay with their blocks, as arrays in
a table between the rounds; the driver sees the sums of entries, entries x components numbers whatever the number of vectors.

Components are whole numbers and distances are compared as such; bounds are rounded so that a doubtful part is popped.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as filled
up with zeros to the longest one's length, and that to a multiple of the parts; entries start with the smallest ids, of
equal ids with the smaller vector, null ids last; with fewer vectors than entries there are as many entries as vectors;
repeated rows count each; a component that a long can't hold ends the query with an error; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blocks import pack, squeeze, unpack, unsqueeze
from framelake.llm.common import materialise, small, trimmed
from framelake.llm.vector_search import _matrix, _wide, quantised

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Vectors of a block, and those that are measured at once.
BLOCK, CHUNK = 4096, 1024
#: Larger components are measured as whole numbers of any size.
SAFE = 1 << 26
_BLOCKS = "block long, n int, vec_ids array<long>, labels array<string>, vectors binary"


def _blocks(width: int):
    """Rows (vec_id, label, v) as blocks of vectors."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held = TaskContext.get().partitionId(), 0, []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            v = _wide(_matrix(rows["v"].combine_chunks()), width)
            row = {"block": (part << 24) | block, "n": rows.num_rows, "vec_ids": rows["vec_id"].to_pylist(), "labels": rows["label"].to_pylist(), "vectors": pack(v.ravel())}
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("n", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.binary())]))

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(i, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield flush(pa.Table.from_batches(held))
                    held, block = [], block + 1
        if held:
            yield flush(pa.Table.from_batches(held))

    return run


def nearest_two(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each part (the first of several), its squared distance, and that of the next one.

    Floats hold whole numbers that stay below 2^53 in all that is done here, so their distances are exact too.
    """
    code, least, second = (np.zeros(len(parts), t) for t in ("int64", parts.dtype, parts.dtype))
    size = (entries**2).sum(axis=1)
    for i in range(0, len(parts), CHUNK):
        part = parts[i : i + CHUNK]
        away = (part**2).sum(axis=1)[:, None] - 2 * (part @ entries.T) + size
        own, rows = away.argmin(axis=1), np.arange(len(away))
        code[i : i + CHUNK], least[i : i + CHUNK] = own, away[rows, own]
        away[rows, own] = away.max(axis=1) + 1
        second[i : i + CHUNK] = away.min(axis=1)
    return code, least, second


def _sums(code: np.ndarray, parts: np.ndarray, entries: int) -> np.ndarray:
    """For each entry the sums of its parts' components, and how many they are."""
    each = np.concatenate((parts, np.ones((len(parts), 1), parts.dtype)), axis=1)
    if parts.dtype == np.float64:
        return np.stack([np.bincount(code, c, entries) for c in each.T], axis=1).astype("int64")
    out = np.zeros((entries, each.shape[1]), parts.dtype)
    np.add.at(out, code, each)
    return out


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype("float64"))


class Heaps:
    """The heaps of one part's entries in a block: (key, row), smallest key first."""

    def __init__(self, heaps: list[list[tuple[float, int]]]) -> None:
        self.heaps = heaps

    @classmethod
    def of(cls, data: bytes, entries: int) -> Heaps:
        raw = unsqueeze(data)
        sizes = np.frombuffer(raw, "<i4", entries)
        n, at = int(sizes.sum()), 4 * entries
        keys, rows = np.frombuffer(raw, "<f8", n, at).tolist(), np.frombuffer(raw, "<i4", n, at + 8 * n).tolist()
        edges = np.concatenate(([0], np.cumsum(sizes))).tolist()
        return cls([list(zip(keys[a:b], rows[a:b])) for a, b in zip(edges, edges[1:])])

    def data(self) -> bytes:
        sizes, flat = np.array(list(map(len, self.heaps)), "<i4"), [x for h in self.heaps for x in h]
        return squeeze(sizes.tobytes() + np.array([k for k, _ in flat], "<f8").tobytes() + np.array([r for _, r in flat], "<i4").tobytes())

    def pop(self, drift: list[float]) -> list[int]:
        """The rows whose bounds the drift has violated."""
        out = []
        for heap, most in zip(self.heaps, drift):
            while heap and heap[0][0] <= most:
                out.append(heapq.heappop(heap)[1])
        return out

    def push(self, rows: list[int], code: np.ndarray, least: np.ndarray, second: np.ndarray, drift: list[float]) -> None:
        near, far = _roots(least), _roots(second)
        slack = (far - near - 1e-12 * (far + near)).tolist()
        fresh = not any(self.heaps)
        for row, entry, key in zip(rows, code.tolist(), slack):
            if fresh:
                self.heaps[entry].append((key + drift[entry], row))
            else:
                heapq.heappush(self.heaps[entry], (key + drift[entry], row))
        if fresh:
            for heap in self.heaps:
                heapq.heapify(heap)


def _assigned(books: list[np.ndarray], drift: list[list[float]], width: int, kind: str, last: bool):
    """A round over blocks: pops, measures, pushes; sums of what moved, and at the end the exact errors."""
    parts, entries, wide = len(books), len(books[0]), width // len(books)

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()), ("codes", pa.binary()), ("errors", pa.list_(pa.int64())), ("heaps", pa.list_(pa.binary())), ("sums", pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())])))])
        for batch in batches:
            for row in batch.to_pylist():
                n, first = row["n"], row.get("codes") is None
                v = unpack(row["vectors"], "int64").reshape(n, width).astype(kind)
                codes = np.zeros((n, parts), "u1") if first else np.frombuffer(row["codes"], "u1").reshape(n, parts).copy()
                errors, heaps, sums = np.zeros(n, kind), [], np.zeros((parts, entries, wide + 1), object if kind == "object" else "int64")
                for p in range(parts):
                    here = v[:, p * wide : (p + 1) * wide]
                    heap = Heaps([[] for _ in range(entries)]) if first else Heaps.of(row["heaps"][p], entries)
                    rows = list(range(n)) if first else heap.pop(drift[p])
                    code, least, second = nearest_two(here[rows], books[p])
                    heap.push(rows, code, least, second, drift[p])
                    moved = np.array(rows, "int64") if first else np.array(rows, "int64")[code != codes[rows, p]]
                    if not first:
                        sums[p] -= _sums(codes[moved, p], here[moved], entries)
                    codes[rows, p] = code
                    sums[p] += _sums(codes[moved, p], here[moved], entries)
                    if last:
                        errors += ((here - books[p][codes[:, p]]) ** 2).sum(axis=1)
                    else:
                        heaps.append(heap.data())
                flat = sums.ravel()
                at = np.flatnonzero(flat != 0)
                out = {c: row[c] for c in ("block", "n", "vec_ids", "labels")} | {"codes": codes.tobytes()}
                out |= {"errors": [int(x) for x in errors.tolist()]} if last else {"vectors": row["vectors"], "heaps": heaps, "sums": [{"at": int(i), "value": str(flat[i])} for i in at]}
                yield pa.RecordBatch.from_pylist([out], schema)

    return run


_ROUND = _BLOCKS + ", codes binary, errors array<long>, heaps array<binary>, sums array<struct<at: int, value: string>>"


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code as bytes, error) of each row of (vec_id, label, v), and the codebook of each part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte for each part")
    rows = materialise(vectors.where("v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "v"), "vectors")
    longest, most = rows.agg(F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    width = max(-(-(longest or 0) // parts) * parts, parts)
    wide = width // parts
    reach = (2 * (most or 0)) ** 2 * wide
    kind = "object" if (most or 0) > SAFE or reach >= 2**62 else "float64" if reach * max(parts, BLOCK) < 2**53 else "int64"
    start = np.array([list(r.v) + [0] * (width - len(r.v)) for r in first], kind).reshape(len(first), width)
    books = [start[:, p * wide : (p + 1) * wide] for p in range(parts)]
    drift, total = [[0.0] * len(first) for _ in range(parts)], np.zeros((parts, len(first), wide + 1), object)
    state = rows.mapInArrow(_blocks(width), _BLOCKS)
    for _ in range(rounds if len(first) else 0):
        state = materialise(state.mapInArrow(_assigned(books, drift, width, kind, False), _ROUND), "round")
        sums = state.select(F.explode("sums").alias("s")).groupBy("s.at").agg(F.sum(F.col("s.value").cast("decimal(38,0)")).alias("value"))
        flat = total.ravel()
        for r in sums.collect():  # entries x components
            flat[r["at"]] += int(r["value"])
        total = flat.reshape(total.shape)
        for p in range(parts):
            count = total[p, :, -1]
            new = np.array([[x // c for x in s] if c else list(old) for s, c, old in zip(total[p, :, :-1], count, books[p])], kind).reshape(books[p].shape)
            moves = _roots(((new - books[p]) ** 2).sum(axis=1)) * (1 + 1e-12)
            order = np.sort(moves)
            others = np.where(moves == order[-1], order[-2], order[-1]) if len(order) > 1 else np.zeros(1)
            drift[p] = ((np.array(drift[p]) + moves + others) * (1 + 1e-12)).tolist()
            books[p] = new
    if not len(first):
        return state.select(F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("string").alias("label"), F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), books
    coded = state.mapInArrow(_assigned(books, drift, width, kind, True), _ROUND)

    @trimmed
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = [row["codes"][i : i + parts] for i in range(0, row["n"] * parts, parts)]
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(codes, pa.binary()), pa.array(row["errors"], pa.int64())], ["vec_id", "label", "code", "error"])

    return coded.select("n", "vec_ids", "labels", "codes", "errors").mapInArrow(spread, "vec_id long, label string, code binary, error long"), books


def codebook_digest(books: list[np.ndarray]) -> str:
    """The digest of all entries' components by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded_embeddings(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the quantised column embedding; codes in hexadecimal digits."""
    taken = embeddings.where("embedding is not null").select("vec_id", "label", F.when(F.size("embedding") > 0, quantised(F.col("embedding"))).otherwise(F.array().cast("array<long>")).alias("v"))
    coded, books = encode(taken, parts, entries, rounds)
    coded = materialise(coded, "coded")
    labels = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    side = labels.withColumnRenamed("label", "of")
    joined = coded.join(small(side, side.count()), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
