"""Removal of word passages that came before, found by recompression.

Rounds rewrite all texts into shorter sequences of symbols that are named alike everywhere. In a round maximal runs of one
symbol and pairs of a symbol of the left and one of the right half (halves by a hash of the name) become new symbols, whose
names Spark gives: blocks of texts send their distinct runs and pairs to buckets, which name what occurs at least twice in
the corpus and give nothing to what occurs once. Round zero names words.

How a place is rewritten depends on some neighbours only. Each symbol carries the span of words that decided it; equal
passages that hold the span hold the same symbol. So a window over the span of a symbol that occurs once occurs once
itself, and is out. What no living window can hold is a gap, and rounds go on in what is left: the symbols shared by
repeats. After ROUNDS rounds the windows left are the repeats and a few others; they are verified by 96-bit digests of
their words, whose first document Spark finds for all blocks at once; within a text the first start stays.

Names are exact and no symbol is followed beyond a window's length: a run or a passage of a period that is longer than the
window has no symbol to name it, and its windows go to the verification.

Defined results: null texts have no words; rows that repeat a doc_id don't remove each other's words, so equal rows get
equal results; null ids come after all others and are one id; texts of fewer words than a window keep all; an empty table gives an empty result; extra columns, whatever their names, are
ignored. A text of any length is one document of one block, whose task holds its words once.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.blocks import ROWS, by_bucket, dealt_words, lists_of, mixed, pack, ranges, slices, squeeze, state_of, table_of, unpack, unsqueeze
from framelake.llm.common import WORD, bounded_batches, bucketed, materialise, release, strings, trimmed, whole
from framelake.sources.scratch import forget

WINDOW, ROUNDS = 20, 2
BLOCK_CHARS = 4 << 20
#: Null ids come after all others.
LAST = (1 << 63) - 1
#: Words of the corpus for each bucket of names; words that are Python objects at a time, in texts of over LONG bytes.
PER_BUCKET, CHUNK, LONG = 2 << 20, 1 << 16, 1 << 20
_WORDS = re.compile(WORD.encode())
_MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def word_chunks(text: str) -> Iterator[list[bytes]]:
    """A text's words; of long texts CHUNK at a time."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= LONG:
        yield data.split()  # at ASCII blanks
        return
    found = (m[0] for m in _WORDS.finditer(data))
    while chunk := list(islice(found, CHUNK)):
        yield chunk


def split_into_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """For each block its documents with their words' places, and its distinct words by bucket."""

    @trimmed
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held, ids, counts, places, known = 0, [], [], [], defaultdict()
        known.default_factory = known.__len__

        def flush() -> Iterator[pa.RecordBatch]:
            name, words = (part << 24) | block, list(known)
            seq = np.concatenate(places) if places else np.zeros(0, "int32")
            many = np.minimum(np.bincount(seq, minlength=len(words)), 2).astype("u1")
            order, at = dealt_words(words, buckets)
            back = np.empty(len(order), "int32")
            back[order] = np.arange(len(order), dtype="int32")
            words, many = [words[i] for i in order.tolist()], many[order]
            lists = ((b, {"words": squeeze(b" ".join(words[i:j])), "many": pack(many[i:j])}) for b, i, j in slices(at))
            yield from table_of(name, lists, {"doc_ids": ids, "n_words": pack(np.array(counts, "int64")), "places": pack(back[seq])}).to_batches()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), strings(batch.column("text"))):
                n = 0
                for words in word_chunks(text):
                    places.append(np.fromiter(map(known.__getitem__, words), "int32", len(words)))
                    n += len(words)
                ids.append(doc), counts.append(n)
                held += len(text)
                if held > BLOCK_CHARS:
                    yield from flush()
                    held, ids, counts, places, block = 0, [], [], [], block + 1
                    known.clear()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(split, ROWS)


def _named(groups: np.ndarray, many: np.ndarray, buckets: int, bucket: int, round_: int) -> np.ndarray:
    """A name for each key of a bucket from its group's number: none (0) for what occurs once."""
    total = np.bincount(groups, many) if len(groups) else np.zeros(0)
    names = np.where(total > 1, np.cumsum(total > 1), 0).astype("int64")
    names = np.where(names > 0, ((names * buckets + bucket) << 3) | round_, 0)
    return names[groups]


def _answers(lengths: list[int], names: np.ndarray) -> list[dict]:
    edges = np.cumsum([0, *lengths]).tolist()
    return [{"names": pack(names[a:b])} for a, b in zip(edges, edges[1:])]


def name_words(buckets: int) -> Callable[[int, list[dict]], list[dict]]:
    def name(bucket: int, lists: list[dict]) -> list[dict]:
        known = defaultdict()
        known.default_factory = known.__len__
        groups = [np.fromiter(map(known.__getitem__, w := unsqueeze(x["words"]).split(b" ")), "int64", len(w)) for x in lists]
        many = np.concatenate([unpack(x["many"], "u1") for x in lists])
        return _answers(list(map(len, groups)), _named(np.concatenate(groups), many, buckets, bucket, 0))

    return name


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorting order of rows by their keys, the last one first, and the number of each row's group of equal last two."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys[-2:]:
        new[1:] |= np.diff(k[order].view("int64")) != 0
    groups = np.empty(len(order), "int64")
    groups[order] = np.cumsum(new)
    return order, groups


def name_pairs(buckets: int, round_: int) -> Callable[[int, list[dict]], list[dict]]:
    def name(bucket: int, lists: list[dict]) -> list[dict]:
        left, right = ([unpack(x[c], "int64") for x in lists] for c in ("left", "right"))
        many = np.concatenate([unpack(x["many"], "u1") for x in lists])
        _, groups = _groups(np.concatenate(left), np.concatenate(right))
        return _answers(list(map(len, left)), _named(groups, many, buckets, bucket, round_))

    return name


def _pending(answers: pa.Table) -> np.ndarray:
    """The names of a block's keys, in the order in which it dealt them."""
    return np.concatenate([unpack(x["names"], "int64") for x in lists_of(answers).values()] or [np.zeros(0, "int64")])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each list's words."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(unpack(pickle.loads(x)["many"], "u1")) for x in batch.column("data").to_pylist()], pa.int64())], ["n"])


class Symbols:
    """A block's symbols in order: name, start, end, and the span [lo, hi) of words that decided them; a hole parts documents."""

    def __init__(self, names, start, end, lo, hi, dead, window: int) -> None:
        self.names, self.start, self.end, self.lo, self.hi, self.dead, self.window = names, start, end, lo, hi, dead, window

    def _keep(self, keep: np.ndarray) -> None:
        for c in ("names", "start", "end", "lo", "hi"):
            setattr(self, c, getattr(self, c)[keep])

    def prune(self) -> None:
        """Windows over what occurs once are dead; symbols without a living window become gaps."""
        once = self.names == 0
        size = len(self.dead) + 1
        change = np.bincount(np.maximum(self.hi[once] - self.window, 0), minlength=size) - np.bincount(self.lo[once] + 1, minlength=size)
        self.dead |= np.cumsum(change[:-1]) > 0
        living = np.concatenate(([0], np.cumsum(~self.dead)))
        self._keep(~once & (living[self.lo + 1] > living[np.maximum(self.hi - self.window, 0)]))

    def rewrite(self, round_: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs, then pairs. Returns each symbol's two halves, name << 6 | repeats; right 0: not a pair, left & 63 = 1: as before."""
        if not len(self.names):
            return self.names, self.names
        touch = self.end[:-1] == self.start[1:]
        first = np.flatnonzero(np.concatenate(([True], ~(touch & (self.names[:-1] == self.names[1:])))))
        last = np.concatenate((first[1:], [len(self.names)])) - 1
        before, after = first[1:-1] - 1, last[1:-1] + 1
        # a run's ends are decided by the symbols beside it; beside a gap nothing is
        inner = np.zeros(len(first), bool)
        inner[1:-1] = touch[before] & touch[after - 1]
        lo, hi = np.minimum.reduceat(self.lo, first), np.maximum.reduceat(self.hi, first)
        lo[1:-1], hi[1:-1] = np.minimum(lo[1:-1], self.lo[before]), np.maximum(hi[1:-1], self.hi[after])
        keep = inner & (hi - lo <= self.window)
        repeats = (last - first + 1)[keep]
        names, start, end, lo, hi = self.names[first][keep], self.start[first][keep], self.end[last][keep], lo[keep], hi[keep]
        unit = (names << 6) | repeats
        if not len(unit):
            self.names, self.start, self.end, self.lo, self.hi = names, start, end, lo, hi
            return unit, unit
        is_left = (mixed(unit, np.full(len(unit), round_)) & np.uint64(1)) == 0
        touch = np.concatenate((end[:-1] == start[1:], [False]))
        pair = np.concatenate((touch[:-1] & is_left[:-1] & ~is_left[1:], [False]))
        second = np.concatenate(([False], pair[:-1]))
        touched = np.concatenate(([False], touch[:-1]))
        # a symbol alone was decided with the neighbour that it looked at: the next one on the left side, else the one before
        alone_left, alone_right = is_left & ~pair & touch, ~is_left & ~second & touched
        last_of, first_of = (a.copy() for a in (hi, lo))
        at = np.flatnonzero(pair | alone_left)
        hi[at], lo[at] = np.maximum(hi[at], last_of[at + 1]), np.minimum(lo[at], first_of[at + 1])
        at = np.flatnonzero(alone_right)
        hi[at], lo[at] = np.maximum(hi[at], last_of[at - 1]), np.minimum(lo[at], first_of[at - 1])
        right = np.where(pair, np.concatenate((unit[1:], [0])), 0)
        end = np.where(pair, np.concatenate((end[1:], [0])), end)
        keep = (pair | alone_left | alone_right) & (hi - lo <= self.window)
        self.names, self.start, self.end, self.lo, self.hi = names[keep], start[keep], end[keep], lo[keep], hi[keep]
        return unit[keep], right[keep]


def _shape(s: Symbols) -> bytes:
    return pack(np.concatenate((s.end - s.start, s.start - s.lo, s.hi - s.end)).astype("u1"))


def _begin(texts: dict, names: np.ndarray, window: int) -> Symbols:
    """The words of a block as symbols."""
    counts, places = unpack(texts["n_words"], "int64"), unpack(texts["places"], "int32")
    begins = np.cumsum(counts + 1) - (counts + 1)
    start = ranges(begins, counts)
    dead = np.ones(int((counts + 1).sum()), bool)
    dead[ranges(begins, np.maximum(counts - window + 1, 0))] = False
    return Symbols(names[places], start, start + 1, start, start + 1, dead, window)


def _resume(state: dict, pending: np.ndarray, window: int) -> Symbols:
    names = np.concatenate((unpack(state["carried"], "int64"), pending))[unpack(state["seq"], "int32")]
    size, before, after = unpack(state["shape"], "u1").reshape(3, -1).astype("int64")
    start = np.cumsum(unpack(state["gaps"], "int32"), dtype="int64")
    end = start + size
    return Symbols(names, start, end, start - before, end + after, _dead_of(state["dead"]), window)


def _dead(s: Symbols) -> bytes:
    return len(s.dead).to_bytes(8, "little") + squeeze(np.packbits(s.dead).tobytes())


def _dead_of(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueeze(data[8:]), "u1"))[: int.from_bytes(data[:8], "little")].astype(bool)


def rewritten(s: Symbols, buckets: int, round_: int) -> tuple[Iterator[tuple[int, dict]], dict]:
    """A block's next symbols: its distinct runs and pairs by bucket, and what it goes on from when they have names."""
    import pandas as pd

    left, right = s.rewrite(round_)
    fresh = (right > 0) | ((left & 63) > 1)
    halves, units = pd.factorize(np.concatenate((left[fresh], right[fresh])))
    n = int(fresh.sum())
    codes, pairs = pd.factorize((halves[:n].astype("int64") << 32) | halves[n:])
    a, b = units[pairs >> 32], units[pairs & 0xFFFFFFFF]
    at = (mixed(a, b) % np.uint64(buckets)).astype("int32")
    order = np.lexsort((b, a, at))
    back = np.empty(len(order), "int32")
    back[order] = np.arange(len(order), dtype="int32")
    a, b, at = a[order], b[order], at[order]
    many = np.minimum(np.bincount(codes, minlength=len(order)), 2).astype("u1")[order]
    old, carried = pd.factorize(s.names[~fresh])
    seq = np.empty(len(left), "int32")
    seq[~fresh], seq[fresh] = old, len(carried) + back[codes]
    lists = ((k, {"left": pack(a[i:j]), "right": pack(b[i:j]), "many": pack(many[i:j])}) for k, i, j in slices(at))
    return lists, {"carried": pack(carried), "seq": pack(seq), "gaps": pack(np.diff(s.start, prepend=0).astype("int32")), "shape": _shape(s), "dead": _dead(s)}


def _words(rows: pa.Table) -> list[bytes]:
    """A block's distinct words in the order of their places."""
    return [w for x in lists_of(rows).values() for w in unsqueeze(x["words"]).split(b" ")]


def _lead(doc: np.ndarray, high: np.ndarray, low: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window's group of equal digests, and each group's row of the smallest document (and before, from the last on)."""
    order, groups = _groups(*before, doc, low.view("int64"), high.view("int64"))
    return groups, order[np.flatnonzero(np.diff(groups[order], prepend=-1))]


def windows(s: Symbols, texts: dict, words: list[bytes], buckets: int) -> tuple[Iterator[tuple[int, dict]], dict]:
    """A block's windows that may repeat, each once with its first document, by bucket of their digests."""
    import xxhash

    at = np.flatnonzero(~s.dead)
    counts, places = unpack(texts["n_words"], "int64"), unpack(texts["places"], "int32")
    begins = np.cumsum(counts + 1) - (counts + 1)
    owner = np.searchsorted(begins, at, side="right") - 1
    doc = np.array([LAST if i is None else i for i in texts["doc_ids"]], "int64")[owner]
    hashed = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    flat, digests = at - owner, []  # there is a hole after each document
    for half, by in enumerate(_MULTIPLY):
        each, key = hashed[:, half][places], np.zeros(len(at), "uint64")
        for j in range(s.window if len(at) else 0):
            key = key * by + each[flat + j]
        digests.append(mixed(key))
    high, low = digests[0], digests[1] >> np.uint64(32)
    groups, lead = _lead(doc, high, low)
    # of a row's equal windows the first stays; rows of one id don't remove each other's
    order = np.lexsort((at, owner, groups))
    first = np.zeros(len(at), bool)
    first[order] = np.concatenate(([True], (np.diff(groups[order]) != 0) | (np.diff(owner[order]) != 0)))[: len(at)]
    here = first & (doc == doc[lead][groups])
    high, low, doc = high[lead], low[lead], doc[lead]
    own = (high % np.uint64(buckets)).astype("int32")
    order = np.lexsort((low, high, own))
    back = np.empty(len(order), "int32")
    back[order] = np.arange(len(order), dtype="int32")
    high, low, doc = high[order], low[order].astype("u4"), doc[order]
    lists = ((k, {"steps": pack(np.diff(high[i:j], prepend=np.uint64(0))), "low": pack(low[i:j]), "doc": pack(doc[i:j])}) for k, i, j in slices(own[order]))
    return lists, {"dead": _dead(s), "seq": pack(back[groups]), "here": squeeze(np.packbits(here).tobytes())}


def first_documents(bucket: int, lists: list[dict]) -> list[dict]:
    """For each list of a bucket, which of its windows have their first document of all in the list's own."""
    high = [np.cumsum(unpack(x["steps"], "uint64"), dtype="uint64") for x in lists]
    low, doc = (np.concatenate([unpack(x[c], k) for x in lists]) for c, k in (("low", "u4"), ("doc", "int64")))
    groups, lead = _lead(doc, np.concatenate(high), low.astype("uint64"))
    return _answers(list(map(len, high)), (doc == doc[lead][groups]).astype("int64"))


def removed_words(texts: dict, words: list[bytes], seen: dict, firsts: np.ndarray, window: int) -> pa.Table:
    """A block's documents without the words that stand in windows that came before."""
    dead = _dead_of(seen["dead"])
    at = np.flatnonzero(~dead)
    here = np.unpackbits(np.frombuffer(unsqueeze(seen["here"]), "u1"))[: len(at)] > 0
    gone = at[~(here & (firsts[unpack(seen["seq"], "int32")] > 0))] if len(at) else at
    counts, places = unpack(texts["n_words"], "int64"), unpack(texts["places"], "int32")
    change = np.zeros(len(dead) + window + 1, "int32")
    change[gone] += 1
    change[gone + window] -= 1
    covered = np.cumsum(change)[: len(dead)] > 0
    begins = np.cumsum(counts + 1) - (counts + 1)
    spelt = np.array(words, dtype=object)
    removed, spans, kept, word = [], [], [], 0
    for b, n in zip(begins.tolist(), counts.tolist()):
        out = covered[b : b + n]
        edges = np.flatnonzero(np.diff(out.astype("i1"), prepend=0, append=0)).reshape(-1, 2).tolist()
        removed.append(int(out.sum()))
        spans.append([{"start": x, "end": y} for x, y in edges])
        kept.append(b" ".join(spelt[places[word : word + n][~out]].tolist()))
        word += n
    release()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    columns = (pa.array(texts["doc_ids"], pa.int64()), pa.array(counts), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string()))
    return pa.table(dict(zip(("doc_id", "n_words", "n_removed", "removed", "kept"), columns)))


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of each row: removed are spans of words, kept the other words by one space."""
    if not 1 <= window <= 63:
        raise ValueError("a window has 1 to 63 words")
    bounded_batches(docs)
    few = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = bucketed(split_into_blocks(docs, few), few, "block")
    total = texts.where("bucket is not null").select("data").mapInArrow(_sums, "n long").agg(F.sum("n")).first()[0]
    buckets = max(few, -(-(total or 0) // PER_BUCKET))

    def made(answers: DataFrame, state: DataFrame | None, rows: DataFrame, make: Callable, schema: str = ROWS) -> DataFrame:
        """make(block, names, state, rows) for each block; its state goes to its rows, with the answers."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return make(right["block"][0].as_py(), _pending(left), state_of(left), right)

        left = answers if state is None else answers.unionByName(state)
        return left.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, schema)

    own = "bucket is null"
    answers, state = by_bucket(texts, few, name_words(few)), None
    for round_ in range(1, rounds + 1):

        def rewrite(block: int, names: np.ndarray, _: dict, rows: pa.Table, resume=_resume if state is not None else _begin, round_=round_) -> pa.Table:
            s = resume(state_of(rows), names, window)
            s.prune()
            out = table_of(block, *rewritten(s, buckets, round_))
            release()
            return out

        before, state = state, bucketed(made(answers, None, (texts if state is None else state).where(own), rewrite), few, "block")
        if before is not None:
            forget(before)
        answers = by_bucket(state, buckets, name_pairs(buckets, round_))

    def verify(block: int, names: np.ndarray, before: dict, rows: pa.Table) -> pa.Table:
        texts = state_of(rows)
        s = _resume(before, names, window) if before else _begin(texts, names, window)
        s.prune()
        out = table_of(block, *windows(s, texts, _words(rows), buckets))
        release()
        return out

    seen = materialise(made(answers, None if state is None else state.where(own), texts, verify), "windows")
    if state is not None:
        forget(state)
    firsts = by_bucket(seen, buckets, first_documents)
    out = "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
    return made(firsts, seen.where(own), texts, lambda _, names, before, rows: removed_words(state_of(rows), _words(rows), before, names, window), out)
