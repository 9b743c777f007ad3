"""Blocks of whole texts as packed arrays, and names that a shuffle gives to what the blocks have in common.

A block stands for its words by places in its own list of distinct words. What must be known of all blocks goes out as
lists, one for each block and bucket, in an order that the block can make again, so that answers come back as plain arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from framelake.llm.common import release

BLOCK_CHARS = 8 << 20
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(values: np.ndarray) -> bytes:
    """An array by planes of its bytes, compressed; high bytes of small numbers take next to nothing."""
    values = np.ascontiguousarray(values)
    return squeeze(values.view("u1").reshape(len(values), values.itemsize).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(unsqueeze(data), "u1")
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def mixed(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of integer columns."""
    out = np.zeros(len(columns[0]), "uint64")
    for c in columns:
        out = (out ^ c.astype("uint64")) * _ODD[0]
        out = (out ^ (out >> np.uint64(29))) * _ODD[1]
        out ^= out >> np.uint64(32)
    return out


def slices(owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of each run of a sorted array."""
    if len(owner):
        starts = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
        yield from zip(owner[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(owner)])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each pair, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def dealt_words(words: list[bytes], buckets: int, salts: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by their buckets, and the buckets in that order."""
    import xxhash

    hashed = xxhash.xxh32_intdigest
    at = np.fromiter((hashed(w) % buckets for w in words), "int32", len(words)) if salts is None else np.fromiter((hashed(w + s) % buckets for w, s in zip(words, salts)), "int32", len(words))
    order = np.argsort(at, kind="stable")
    return order, at[order]


#: A blob's rows have at most so many bytes: the JVM keeps larger arrays apart and frees them late.
PIECE = 256 << 10
#: Lists carry their bucket, a block's own state the number of each of its pieces.
ROWS = "block long, bucket int, piece int, data binary"
_ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("piece", pa.int32()), ("data", pa.binary())])


def table_of(block: int, lists: Iterator[tuple[int, dict]], state: dict | None = None) -> pa.Table:
    """A block's lists, (bucket, content), and its state as rows."""
    buckets, data = [], []
    for bucket, content in lists:
        buckets.append(bucket), data.append(pickle.dumps(content))
    whole = pickle.dumps(state) if state is not None else b""
    pieces = [whole[i : i + PIECE] for i in range(0, len(whole), PIECE)]
    number = [None] * len(data) + list(range(len(pieces)))
    return pa.Table.from_arrays([pa.array([block] * len(number), pa.int64()), pa.array(buckets + [None] * len(pieces), pa.int32()), pa.array(number, pa.int32()), pa.array(data + pieces, pa.binary())], schema=_ROWS)


def state_of(table: pa.Table) -> dict:
    """A block's state from its rows, whatever else is among them."""
    pieces = {i: x for i, x in zip(table["piece"].to_pylist(), table["data"].to_pylist()) if i is not None}
    return pickle.loads(b"".join(pieces[i] for i in sorted(pieces))) if pieces else {}


def lists_of(table: pa.Table) -> dict[int, dict]:
    """A block's lists by bucket, in order."""
    lists = {b: x for b, x in zip(table["bucket"].to_pylist(), table["data"].to_pylist()) if b is not None}
    return {b: pickle.loads(lists[b]) for b in sorted(lists)}


def by_bucket(rows: DataFrame, buckets: int, answer: Callable[[int, list[dict]], list[dict]]) -> DataFrame:
    """For all lists of a bucket, in blocks' rows, what answer(bucket, lists) gives each; what it gives beyond is of no block."""

    def run(table: pa.Table) -> pa.Table:
        out = answer(table["bucket"][0].as_py(), [pickle.loads(x) for x in table["data"].to_pylist()])
        release()
        beyond = [None] * (len(out) - table.num_rows)
        columns = [table["block"].to_pylist() + beyond, table["bucket"].to_pylist() + beyond, [None] * len(out), list(map(pickle.dumps, out))]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, _ROWS.types)], schema=_ROWS)

    lists = rows.where("bucket is not null").select("block", "bucket", "piece", "data")
    return lists.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(run, ROWS)
