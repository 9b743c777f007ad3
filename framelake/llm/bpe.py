"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. A task splits its whole texts into pre-tokens. The texts of about BLOCK_CHARS form a block: its distinct words, in the
   order in which they come, and for each document the places of its words among these. Both are written once, in
   buckets of the block.
2. The blocks' words are dealt by their hash, a list for each block and bucket, so each distinct word of the corpus meets
   in one bucket, whose task holds its distinct words and encodes each once.
3. The ids go back to the blocks and are joined to the documents' word places, which the buckets keep from being moved;
   this gives each document's ids in order.
4. Decoding joins the table of token bytes (at most its vocabulary's size) to the ids.

A block stands for its positions as arrays, so that a row is neither written for each pre-token nor moved for it; a very
common word has one entry in each block.

Defined results: null texts are empty and have no ids; repeated rows are returned each; extra columns, whatever their
names, are ignored; an empty table gives an empty result. A text of any length is one document of one block, whose task
holds its words once. Special strings in texts are ordinary text. All machines need the rank file at its path.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, bucketed, release, strings, trimmed, whole

BLOCK_CHARS = 32 << 20
#: Documents whose word places are one row, and lists of words that Arrow moves at once.
RUN, LISTS = 256, 64


@lru_cache(maxsize=2)  # a worker keeps them over its tasks
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def _pack(places: np.ndarray) -> bytes:
    """Word places by planes of their bytes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(places.astype("<u4").view("u1").reshape(-1, 4).T.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


_BLOCKS = "block long, bucket int, words array<string>, numbers binary, doc_ids array<{id}>, n_words array<int>, places binary"


def split_into_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: a block's distinct words by bucket, with their numbers, and runs of documents with their words' numbers."""
    rows = docs.select("doc_id", whole().alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    @trimmed
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex
        import xxhash

        find, part, block = regex.compile(public_tokenizers.PATTERN).findall, TaskContext.get().partitionId(), 0
        held, ids, places, known, schema = 0, [], [], {}, None

        def run_of() -> pa.RecordBatch:
            row = {"block": (part << 24) | block, "doc_ids": list(ids), "n_words": [len(p) for p in places], "places": _pack(np.concatenate(places))}
            ids.clear(), places.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        def words_of() -> Iterator[pa.RecordBatch]:
            at = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in known), "int64", len(known))
            words, order = pa.array(known, pa.string()), np.argsort(at, kind="stable")
            own, starts = np.unique(at[order], return_index=True)
            ends = [*starts[1:].tolist(), len(order)]
            for i in range(0, len(own), LISTS):
                lists = [order[a:b] for a, b in zip(starts[i : i + LISTS].tolist(), ends[i : i + LISTS])]
                texts = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]), pa.int32()), words.take(pa.array(np.concatenate(lists))))
                n = len(lists)
                columns = [pa.array([(part << 24) | block] * n, pa.int64()), pa.array(own[i : i + n], pa.int32()), texts, pa.array([_pack(x) for x in lists], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, schema.field(c).type) for c in schema.names[4:])], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.list_(pa.string())), ("numbers", pa.binary()), ("doc_ids", pa.list_(batch.schema.field("doc_id").type)), ("n_words", pa.list_(pa.int32())), ("places", pa.binary())])
            for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                found = pa.array(find(text), pa.string()).dictionary_encode()
                own = np.fromiter((known.setdefault(w, len(known)) for w in found.dictionary.to_pylist()), "int32", len(found.dictionary))
                places.append(own[found.indices.to_numpy()])
                ids.append(doc)
                held += len(text)
                if len(ids) == RUN:
                    yield run_of()
                if held > BLOCK_CHARS:
                    if ids:
                        yield run_of()
                    yield from words_of()
                    held, known, block = 0, {}, block + 1
        if ids:
            yield run_of()
        yield from words_of()

    return rows.mapInArrow(split, _BLOCKS.format(id=id_type))


def encode_words(lists: DataFrame, ranks_path: str) -> DataFrame:
    """(block, bucket, ids, lengths): the ids of each list's words one after the other, and how many each word has.

    Lists come sorted by bucket: a bucket's words are remembered until it ends.
    """

    @trimmed
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder, known, last = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks_path), special_tokens={}), {}, None
        for batch in batches:
            packed: list[list[bytes]] = [[], []]
            for bucket, words in zip(batch.column("bucket").to_pylist(), strings(batch.column("words"), 1)):
                if bucket != last:
                    last, known = bucket, {}
                for w in words:
                    if w not in known:
                        known[w] = np.array(coder.encode_ordinary(w), "<u4").tobytes()
                each = [known[w] for w in words]
                packed[0].append(_pack(np.frombuffer(b"".join(each), "<u4")))
                packed[1].append(_pack(np.fromiter(map(len, each), "<u4", len(each)) // 4))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), *(pa.array(x, pa.binary()) for x in packed)], ["block", "bucket", "ids", "lengths"])

    return lists.mapInArrow(encode, "block long, bucket int, ids binary, lengths binary")


def _gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start : start + length] of each pair, one after the other."""
    ends = np.cumsum(lengths)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
    return values[at]


def _assemble(kind: pa.DataType, ranks_path: str, with_ids: bool):
    """Joins a block's ids to its documents' word places; digests of ids and of decoded bytes, or the ids themselves."""

    def assemble(words: pa.Table, runs: pa.Table) -> pa.Table:
        found = dict(zip(words["bucket"].to_pylist(), zip(*(words[c].to_pylist() for c in ("ids", "lengths")))))
        lists = [(_unpack(n), *map(_unpack, found[b])) for b, n in zip(*(runs[c].to_pylist() for c in ("bucket", "numbers"))) if n is not None]
        order, ids, own = (np.concatenate([x[i] for x in lists]) if lists else np.zeros(0, "<u4") for i in range(3))
        own = own.astype("int64")
        lens, starts = np.zeros(len(order), "int64"), np.zeros(len(order), "int64")
        lens[order], starts[order] = own, np.cumsum(own) - own
        table = sorted(read_ranks(ranks_path).items(), key=lambda x: x[1])
        tokens = np.frombuffer(b"".join(t for t, _ in table), "u1")
        token_lens = np.zeros(table[-1][1] + 1, "int64")
        token_lens[[i for _, i in table]] = [len(t) for t, _ in table]
        token_starts = np.cumsum(token_lens) - token_lens
        out: list[list] = [[] for _ in range(4)]
        for at in np.flatnonzero(np.asarray(runs["places"].is_valid())).tolist():
            docs, counts, places = (runs[c][at].as_py() for c in ("doc_ids", "n_words", "places"))
            place = _unpack(places)
            all_lens = lens[place]
            all_ids = _gather(ids, starts[place], all_lens).astype("<u4")
            raw = _gather(tokens, token_starts[all_ids], token_lens[all_ids]) if not with_ids else None
            edges = np.concatenate(([0], np.cumsum(all_lens)))[np.concatenate(([0], np.cumsum(counts)))]
            bytes_at = np.concatenate(([0], np.cumsum(token_lens[all_ids])))[edges]
            for i, doc in enumerate(docs):
                own = all_ids[edges[i] : edges[i + 1]]
                out[0].append(doc)
                out[1].append(len(own))
                out[2].append(own.astype("int32") if with_ids else hashlib.sha256(own.tobytes()).hexdigest())
                if not with_ids:
                    out[3].append(hashlib.sha256(raw[bytes_at[i] : bytes_at[i + 1]].tobytes()).hexdigest())
        release()
        if with_ids:
            return pa.table([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])
        return pa.table([pa.array(out[0], kind), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return assemble


def encode(docs: DataFrame, ranks_path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; with_ids: (doc_id, n_tokens, ids) instead."""
    bounded_batches(docs)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(split_into_blocks(docs, buckets), buckets, "block")
    lists = blocks.where("words is not null").select("block", "bucket", "words").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    runs = blocks.select("block", "bucket", "numbers", "doc_ids", "n_words", "places")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = blocks.select("doc_ids").limit(0).toArrow().schema.field("doc_ids").type.value_type
    out = f"doc_id {id_type}, n_tokens long, " + ("ids array<int>" if with_ids else "ids_sha256 string, decoded_sha256 string")
    return encode_words(lists, ranks_path).groupBy("block").cogroup(runs.groupBy("block")).applyInArrow(_assemble(kind, ranks_path, with_ids), out)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """(doc_id, decoded): the bytes of each row's ids by a join to the token-byte table; unknown ids give null."""

    @trimmed
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: t for t, i in read_ranks(ranks_path).items()}
        for batch in batches:
            rows = [None if x is None or any(i not in table for i in x) else b"".join(map(table.__getitem__, x)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], ["doc_id", "decoded"])

    rows = encoded.select("doc_id", ids)
    return rows.mapInArrow(join, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")
