"""Collocations of each language, counted as Suffix-sigma counts n-grams.

1. Blocks of whole texts send their distinct words with counts to buckets, which add them up and name the words that are
   frequent enough to stand in a candidate; the others end a piece, as no phrase over them can be frequent.
2. Blocks send each suffix of a piece, cut after max_n words, once with its count, to buckets by language and first word.
   The first words that come often are dealt by their second word too, pairs of very common words by the third, and triples
   of them by the fourth, so that no bucket holds a common word's or line's rows alone.
3. A bucket sorts its suffixes in reverse lexicographic order, where equal prefixes stand together, and counts all prefixes
   in one pass with one stack of open prefixes. What was dealt by further words is added up over the buckets.
4. Joins by phrase give each candidate the counts of its parts, and of the longer candidates that hold it.

Defined results: null texts are empty; a null language is `und`; repeated rows count each; phrases don't cross the ends of
pieces; an empty table, or one without frequent phrases, gives an empty result; extra columns, whatever their names, are
ignored. A text of any length is one document of one block, whose task holds its words' places once.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.blocks import BLOCK_CHARS, ROWS, by_bucket, lists_of, mixed, pack, slices, squeeze, state_of, table_of, unpack, unsqueeze
from framelake.llm.common import bounded_batches, bucketed, materialise, release, small, strings, trimmed, whole

MAX_N, LEAST, INSIDE, TOP = 4, 30, (80, 100), 2000
#: Suffixes of the corpus for each bucket; one of so many words is very common; words that are Python objects at a time, in texts of over LONG bytes.
PER_BUCKET, COMMON, CHUNK, LONG = 1 << 20, 64, 1 << 16, 1 << 20
#: Named words that are one row.
NAMED = 4096
#: A-Z lower-cased, what ends a piece as a line feed.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d", bytes(range(97, 123)) + b"\n" * 9)
_TOKENS = re.compile(rb"[^\n \t]+|\n+")


def pieces(text: str) -> Iterator[list[bytes | None]]:
    """A text's words, with None at the ends of pieces; of long texts CHUNK words at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    if len(data) <= LONG:
        out: list[bytes | None] = []
        for piece in data.split(b"\n"):
            out += piece.split()
            out.append(None)
        yield out
        return
    found = (m[0] for m in _TOKENS.finditer(data))
    while chunk := list(islice(found, CHUNK)):
        yield [None if w[0] == 10 else w for w in chunk]
    yield [None]


def split_into_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """For each block its words' places in order, and its distinct words with counts by language and bucket."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole().alias("text"))

    @trimmed
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        part, block = TaskContext.get().partitionId(), 0
        held, places, known, number = 0, [], {}, count(1)

        def flush() -> list[pa.RecordBatch]:
            name, langs = (part << 24) | block, list(known)
            seq = np.concatenate(places)
            pairs = [(i, w) for i, x in enumerate(langs) for w, at in known[x].items() if at]
            at = np.fromiter((k for x in langs for k in known[x].values() if k), "int64", len(pairs))
            owner = np.fromiter((i for i, _ in pairs), "int32", len(pairs))
            bucket = np.fromiter((xxhash.xxh32_intdigest(w, i) % buckets for i, w in zip((xxhash.xxh32_intdigest(langs[i]) for i, _ in pairs), (w for _, w in pairs))), "int32", len(pairs))
            order = np.lexsort((at, owner, bucket))
            back = np.zeros(len(order) + 1, "int32")
            back[at[order]] = np.arange(1, len(order) + 1, dtype="int32")
            counts = np.bincount(seq, minlength=len(order) + 1)[at[order]]
            words, own, at = [pairs[i][1] for i in order.tolist()], owner[order], bucket[order]
            lists = ((b, [{"lang": langs[k], "words": squeeze(b" ".join(words[x:y])), "counts": pack(counts[x:y])} for k, x, y in ((k, x + i, y + i) for k, x, y in slices(own[i:j]))]) for b, i, j in slices(at))
            return table_of(name, lists, {"langs": langs, "lang_of": pack(own), "places": pack(back[seq])}).to_batches()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text"))):
                own = known.get(lang)
                if own is None:
                    own = known[lang] = defaultdict(number.__next__, {None: 0})
                for words in pieces(text):
                    places.append(np.fromiter(map(own.__getitem__, words), "int32", len(words)))
                held += len(text)
                if held > BLOCK_CHARS:
                    yield from flush()
                    held, places, known, number, block = 0, [], {}, count(1), block + 1
        if places:
            yield from flush()

    return rows.mapInArrow(split, ROWS)


def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n) of each list."""
    for batch in batches:
        rows = [(x["lang"], int(unpack(x["counts"], "int64").sum())) for data in batch.column("data").to_pylist() for x in pickle.loads(data)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["lang", "n"])


def name_words(buckets: int, least: int, often: int, common: int) -> Callable[[int, list], list[dict]]:
    """Names of a bucket's words that come at least least times; their last two bits tell how common they are.

    Beyond the lists it gives the words that are named.
    """

    def name(bucket: int, lists: list) -> list[dict]:
        known: dict[str, defaultdict] = {}
        number, places, counts = count(), [], []
        for parts in lists:
            each = []
            for part in parts:
                own = known.setdefault(part["lang"], defaultdict(number.__next__))
                words = unsqueeze(part["words"]).split(b" ")
                each.append(np.fromiter(map(own.__getitem__, words), "int64", len(words)))
                counts.append(unpack(part["counts"], "int64"))
            places.append(np.concatenate(each))
        sums = np.bincount(np.concatenate(places), np.concatenate(counts)).astype("int64")
        frequent = sums >= least
        ids = (np.cumsum(frequent) - 1) * buckets + bucket + 1
        ids = np.where(frequent, (ids << 2) | (sums > often).astype("int64") + (sums > max(often, common)), 0)
        out = [{"names": pack(ids[p])} for p in places]
        named = [(lang, w.decode("utf-8", "surrogatepass"), int(ids[i]), int(sums[i])) for lang, own in known.items() for w, i in own.items() if frequent[i]]
        return out + [named[i : i + NAMED] for i in range(0, len(named), NAMED)]

    return name


def named_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, id, f) of the words that are named."""
    for batch in batches:
        rows = [x for data in batch.column("data").to_pylist() for x in pickle.loads(data)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "word", "id", "f"])


def suffixes(max_n: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's distinct suffixes of max_n words, with counts, by language and bucket."""
    import pandas as pd

    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def cut(names: pa.Table, texts: pa.Table) -> pa.Table:
        ids = np.concatenate([np.zeros(1, "int64"), *(unpack(x["names"], "int64") for x in lists_of(names).values())])
        row = state_of(texts)
        seq = unpack(row["places"], "int32")
        seq = np.where(ids[seq] == 0, np.int32(0), seq)
        seq = np.concatenate((seq, np.zeros(max_n, "int32")))
        at = np.flatnonzero((seq[: len(seq) - 1] > 0) & (seq[1:] > 0))
        codes, kinds = np.zeros(len(at), "int64"), []
        open_ = np.ones(len(at), bool)
        for j in range(max_n):  # rows of words become one number, a column at a time
            word = np.where(open_, seq[at + j], 0)
            open_ &= word > 0
            code, kind = pd.factorize((codes << 32) | word)
            codes = code.astype("int64")
            kinds.append(kind)
        counts = np.bincount(codes) if len(codes) else np.zeros(0, "int64")
        rows, last = [], np.arange(len(counts))
        for kind in reversed(kinds):
            rows.append(kind[last] & 0xFFFFFFFF)
            last = kind[last] >> 32
        places = rows[::-1]
        words = [ids[p] for p in places]
        level = [w & 3 for w in words]
        key = mixed(words[0])
        for j in range(1, max_n):
            deeper = np.minimum.reduce(level[:j]) >= min(j, 2)
            key = np.where(deeper, mixed(key, words[j]), key)
        bucket = (key % np.uint64(buckets)).astype("int64")
        langs = row["langs"]
        owner = unpack(row["lang_of"], "int32")[places[0] - 1].astype("int64") if len(counts) else bucket
        lists = owner * buckets + bucket
        order = np.lexsort((*words[::-1], lists))
        out = [{"lang": langs[k // buckets], "bucket": k % buckets, "words": pack(np.concatenate([w[order[i:j]] for w in words])), "counts": pack(counts[order[i:j]])} for k, i, j in slices(lists[order])]
        release()
        return pa.Table.from_pylist(out, schema)

    return cut


class PrefixStack:
    """Counts all prefixes of rows that come in reverse lexicographic order.

    It holds the prefixes that are still open, one of each length, with their counts. A row that differs closes those
    beyond what it shares with the row before; push() does this for many rows at a time.
    """

    def __init__(self, max_n: int) -> None:
        self.open, self.counts = [None] * (max_n + 1), [0] * (max_n + 1)

    def push(self, words: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(prefixes of one length, counts) of what the rows close; zeros end a row."""
        if not len(words):
            return
        differs = np.zeros(len(words), bool)
        differs[0] = True
        for n in range(1, words.shape[1] + 1):
            differs[1:] |= words[1:, n - 1] != words[:-1, n - 1]
            starts = np.flatnonzero(differs)
            prefixes, sums = words[starts, :n], np.add.reduceat(counts, starts)
            if self.open[n] is not None:
                if (self.open[n] == prefixes[0]).all():
                    sums[0] += self.counts[n]
                else:
                    prefixes, sums = np.vstack((self.open[n], prefixes)), np.concatenate(([self.counts[n]], sums))
            self.open[n], self.counts[n] = prefixes[-1], sums[-1]
            full = prefixes[:-1, -1] > 0
            yield prefixes[:-1][full], sums[:-1][full]

    def close(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n, prefix in enumerate(self.open):
            if prefix is not None and prefix[-1] > 0:
                yield prefix[None, :], np.array([self.counts[n]])


def count_prefixes(max_n: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """(lang, p, f, part): prefixes of 2 and more words of a bucket's suffixes; part marks counts that other buckets add to."""

    def count_all(table: pa.Table) -> pa.Table:
        counts = [unpack(x, "int64") for x in table["counts"].to_pylist()]
        words = np.concatenate([unpack(x, "int64").reshape(max_n, -1) for x in table["words"].to_pylist()], axis=1)
        counts = np.concatenate(counts)
        order = np.lexsort(words[::-1])[::-1]
        words, counts, stack = np.ascontiguousarray(words[:, order].T), counts[order], PrefixStack(max_n)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def keep(closed: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
            for p, f in closed:
                n = p.shape[1]
                if n > 1:
                    part = ((p & 3).min(axis=1) >= 2) & (n < max_n)
                    good = part | (f >= least)
                    found.append((p[good], f[good], part[good]))

        for i in range(0, len(words), 1 << 16):
            keep(stack.push(words[i : i + (1 << 16)], counts[i : i + (1 << 16)]))
        keep(stack.close())
        lengths = np.concatenate([np.full(len(f), p.shape[1]) for p, f, _ in found] or [np.zeros(0, "int64")])
        flat = np.concatenate([p.ravel() for p, _, _ in found] or [np.zeros(0, "int64")])
        f, part = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind) for i, kind in ((1, "int64"), (2, bool)))
        release()
        p = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(flat, pa.int64()))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(f), pa.string()), "p": p, "f": pa.array(f.astype("int64")), "part": pa.array(part)})

    return count_all


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, p, f) of phrases of 2 to max_n words that come at least least times, p their words' ids; (lang, id, word, f) of such words; (lang, n)."""
    bounded_batches(docs)
    few = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = bucketed(split_into_blocks(docs, few), few, "block")
    words = texts.where("bucket is not null")
    sizes = materialise(words.select("data").mapInArrow(sums_of, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(few, -(-total // PER_BUCKET))
    named = materialise(by_bucket(texts, few, name_words(few, least, total // (4 * buckets), total // COMMON)), "names")
    vocabulary = materialise(named.where("block is null").select("data").mapInArrow(named_words, "lang string, word string, id long, f long"), "vocabulary")
    cut = named.where("block is not null").groupBy("block").cogroup(texts.where("bucket is null").groupBy("block")).applyInArrow(suffixes(max_n, buckets), "lang string, bucket int, words binary, counts binary")
    counted = cut.repartition(buckets, "lang", "bucket").groupBy("lang", "bucket").applyInArrow(count_prefixes(max_n, least), "lang string, p array<long>, f long, part boolean")
    counted = materialise(counted, "counted")
    added = counted.where("part").groupBy("lang", "p").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return materialise(counted.where("not part").select("lang", "p", "f").unionByName(added.select("lang", "p", "f")), "phrases"), vocabulary, sizes


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP, scale: int = 2_000_000, inside: tuple[int, int] = INSIDE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the top best phrases of each language.

    Cut after its first words, a phrase of count a has parts of counts l and r and score floor(scale * a / (l + r)); the cut
    of the lowest score counts, the first of several. A phrase is out where a longer one that holds it has a count of at
    least inside (a fraction) of its own.
    """
    phrases, vocabulary, sizes = phrase_counts(docs, max_n, least)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    length = F.size("p")
    parts = phrases.select("p", "f").unionByName(vocabulary.select(F.array("id").alias("p"), "f"))
    cuts = phrases.select("lang", "p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("k")), "right": F.slice("p", F.col("k") + 1, length - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("p").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    scored = cuts.withColumn("score", F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "p", "a", "cut.score", "cut.l", "cut.r")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), length - 1), lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.slice("p", i, n))))
    held = phrases.where(length > 2).select(F.explode(spans).alias("p"), "f").groupBy("p").agg(F.max("f").alias("longer"))
    most, of = inside
    out = exact("longer") * F.lit(of) >= exact("a") * F.lit(most)
    kept = best.join(held, "p", "left").where(~F.coalesce(out, F.lit(False)))
    order = [F.desc("score"), F.desc("a")]
    first = kept.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "longer")
    first = materialise(first, "first")
    words = vocabulary.select("id", "word").join(first.select(F.explode("p").alias("id")).distinct().hint("shuffle_hash"), "id")
    spelt = first.select("lang", "p", F.posexplode("p").alias("at", "id")).join(words, "id").groupBy("lang", "p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = first.join(spelt, ["lang", "p"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= top)
    return rows.join(small(sizes, sizes.count()), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
