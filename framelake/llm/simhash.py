"""SimHash near-duplicate detection with BK-trees.

Fingerprints are 64 bits wide; two link at RADIUS or fewer differing bits. With the bits dealt into blocks, all but
RADIUS of the blocks must then agree, so each distinct fingerprint goes to a shard for each choice of agreeing blocks,
named by as many of their bits as bring a shard of unlike texts down to about SHARD fingerprints. Over each shard stands
a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows only edges within RADIUS of
its own distance; all fingerprints of the shard go down together. Trees hold the fingerprints of all documents, so they
are neither brought to the driver nor broadcast: fingerprints go to their shards instead. A shard of more than PIECE
fingerprints is split: its pieces' trees are each searched by the other pieces, in pairs. A shard gives links that join
what it found connected, not all pairs.

Components come from repeated star contractions of the links, with a table in the shared folder between the rounds.

representatives() joins near copies: texts whose sets of WIDTH-word shingles have a Jaccard similarity of NEAR or more.
Candidates are the sets whose fingerprints, of these shingles, the BK-trees connect within RADIUS. Copies further apart
(some 10 bits at 0.8, where a BK-tree leaves nothing out) come besides from BANDS bands of ROWS min-hashes. Each link is
checked on the sets themselves. A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS, 0.9998 at 0.8
and more above it; it must be linked directly or through others.

Defined results: null texts are empty; a text without words has fingerprint zero and links like any other; repeated
rows get equal results; a null id is never a component's name unless all its ids are null; an empty table gives an empty
result; extra columns, whatever their names, are ignored by components() and kept by representatives(). A text of any
length is read CHUNK words at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from framelake.llm.common import WORD, bounded_batches, materialise, release, small, strings, trimmed, whole
from framelake.operators.graph import connected

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a shard, those beyond which it is split, and those that a tree keeps as a plain list.
SHARD, PIECE, LEAF = 2048, 8192, 8
#: Words that are Python objects at a time, in texts of over LONG bytes.
CHUNK, LONG = 1 << 16, 1 << 20
#: Near copies: words of a shingle and the least Jaccard similarity (a fraction); bands and min-hashes of each.
WIDTH, NEAR, BANDS, ROWS = 5, (4, 5), 28, 6
#: Sets of a shard that a task holds are twice as many.
PART = 512
_TIMES = np.random.RandomState(SEED).randint(0, 1 << 63, BANDS * ROWS, "uint64") * np.uint64(2) + np.uint64(1)
_FLIP = np.random.RandomState(SEED + 1).randint(0, 1 << 63, BANDS * ROWS, "uint64") * np.uint64(2)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS = re.compile(WORD.encode())


def shingle_chunks(text: str, width: int, digest) -> Iterator[list]:
    """The digests of a text's shingles of width lower-cased words, in order; fewer words are one shingle."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    found = iter(_WORDS.findall(data)) if len(data) <= LONG else (m[0] for m in _WORDS.finditer(data))
    before: list[bytes] = []
    while new := list(islice(found, CHUNK)):
        words = before + new
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts, stops = [0, *ends[:-1].tolist()], (ends - 1).tolist()
        yield [digest(line[a:b], SEED) for a, b in zip(starts, stops[min(width, len(words)) - 1 :])]
        before = words[-(width - 1) :] if len(words) >= width else []


def fingerprint(text: str) -> int:
    """64 bits, each set if it is set in over half of the hashes of all shingles, repeats included."""
    import xxhash

    total, n = np.zeros(64, "int64"), 0
    for digests in shingle_chunks(text, SHINGLE, xxhash.xxh64_digest):
        total += np.unpackbits(np.frombuffer(b"".join(digests), "u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
        n += len(digests)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


@F.arrow_udf(LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    """fingerprint as a signed long."""
    return pa.array([((x := fingerprint(s)) ^ (1 << 63)) - (1 << 63) for s in strings(texts)], pa.int64())


class BKTree:
    """Children keyed by integer Hamming distance to the parent; up to LEAF values are kept as a plain list."""

    def __init__(self, values: np.ndarray, places: np.ndarray) -> None:
        self.places = places
        self.leaf = values if len(values) <= LEAF else None
        self.children: dict[int, BKTree] = {}
        if self.leaf is None:
            self.value = values[0]
            away = np.bitwise_count(values[1:] ^ self.value)
            order = np.argsort(away, kind="stable")
            edges = np.flatnonzero(np.diff(away[order], prepend=255))
            for own in np.split(order + 1, edges[1:]):
                self.children[int(away[own[0] - 1])] = BKTree(values[own], places[own])

    def search(self, queries: np.ndarray, asked: np.ndarray, found: list, radius: int = RADIUS) -> int:
        """Appends (query places, tree places) of the pairs within radius; queries go down together.

        Returns how many distances it took.
        """
        if self.leaf is not None:
            i, j = np.nonzero(np.bitwise_count(queries[:, None] ^ self.leaf) <= radius)
            found.append((asked[i], self.places[j]))
            return len(queries) * len(self.leaf)
        away = np.bitwise_count(queries ^ self.value).astype("int64")
        near = away <= radius
        found.append((asked[near], np.full(int(near.sum()), self.places[0])))
        took = len(queries)
        for d, child in self.children.items():
            if (on := np.abs(away - d) <= radius).any():
                took += child.search(queries[on], asked[on], found, radius)
        return took


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the smallest place of its set, after the sets of a's places are joined with those of b's."""
    while len(on := np.flatnonzero(label[a] != label[b])):
        least, one, two = np.arange(len(label)), label[a[on]], label[b[on]]
        np.minimum.at(least, np.maximum(one, two), np.minimum(one, two))
        while (least[least] != least).any():
            least = least[least]
        label = least[label]
    return label


def _linked(values: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected by pairs of first with second (places in values)."""
    values = values.view("uint64")
    label, tree = np.arange(len(values)), BKTree(values[second], second)
    for start in range(0, len(first), 1024):
        found: list = []
        tree.search(values[first[start : start + 1024]], first[start : start + 1024], found)
        label = _joined(label, *(np.concatenate(x) for x in zip(*found)))
    on = np.flatnonzero(label != np.arange(len(values)))
    return values[on].view("int64"), values[label[on]].view("int64")


def masks_for(n: int) -> list[int]:
    """Masks of bits, of which two fingerprints within RADIUS agree in one, as few as bring n unlike ones to SHARD a shard."""
    bits = max(0, math.ceil(math.log2(max(1, n) / SHARD)))
    blocks = next((b for b in range(RADIUS + 1, 12) if bits <= 64 * (b - RADIUS) // b), 12)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - RADIUS):
        places = [p for step in range(64) for c in chosen if (p := edges[c] + step) < edges[c + 1]]
        masks.append(sum(1 << p for p in places[:bits]))
    return [m - (1 << 64) * (m >> 63) for m in dict.fromkeys(masks)]


def links(prints: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect all of n distinct prints (column fp) within RADIUS of each other."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks_for(n))]))
    shards = prints.select("fp", each.alias("s")).select("fp", F.xxhash64("s.mask", "s.part").alias("shard"))
    sizes = shards.groupBy("shard").count()
    hot = materialise(sizes.where(F.col("count") > PIECE).select("shard", F.ceil(F.col("count") / PIECE).cast("int").alias("pieces")), "hot")
    none = hot.count() == 0
    usual = shards if none else shards.join(hot, "shard", "left_anti")

    @trimmed
    def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard; those whose shard isn't complete wait for the next batch."""
        rest = np.zeros((2, 0), "int64")

        def link(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.diff(rows[0], prepend=rows[0, :1] - 1)) if rows.shape[1] else []
            for own in np.split(rows[1], edges[1:]):
                a, b = _linked(own, np.arange(len(own)), np.arange(len(own))) if len(own) > 1 else (own[:0], own[:0])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.concatenate((rest, np.stack([batch.column(c).to_numpy() for c in ("shard", "fp")])), axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            yield from link(rows[:, :cut])
            rest = rows[:, cut:]
        yield from link(rest)

    found = usual.repartition("shard").sortWithinPartitions("shard").select("shard", "fp").mapInArrow(by_shard, "a long, b long")
    if none:
        return found

    def piece_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        values, piece = pdf["fp"].to_numpy("int64"), pdf["piece"].to_numpy()
        one, two = pdf["lower"].iat[0], pdf["upper"].iat[0]
        a, b = _linked(values, np.flatnonzero(piece == one), np.flatnonzero(piece == two))
        return pd.DataFrame({"a": a, "b": b})

    own = shards.join(hot, "shard").withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    met = own.select("shard", "fp", "piece", other).select("shard", "fp", "piece", F.least("piece", "other").alias("lower"), F.greatest("piece", "other").alias("upper"))
    return found.unionByName(met.groupBy("shard", "lower", "upper").applyInPandas(piece_pair, "a long, b long"))


def _hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): component_id is the smallest id reachable by links."""
    bounded_batches(docs)
    prints = materialise(docs.select("doc_id", fingerprint_udf(whole()).alias("fp")), "prints")
    owners = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "owners")
    roots = materialise(connected(links(owners.select("fp"), owners.count())), "roots")
    # a component's name is the smallest id of all its prints, whichever print is its root
    groups = roots.join(owners, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("m"))
    groups = groups.join(owners, F.col("root") == F.col("fp")).select("root", F.least("m", "least").alias("name"))
    named = roots.join(groups, "root").select(F.col("node").alias("fp"), "name").unionByName(groups.select(F.col("root").alias("fp"), "name"))
    names = owners.join(named, "fp", "left").select("fp", F.coalesce("name", "least").alias("component_id"))
    names = materialise(names, "names")  # a plain table, so that Spark may split the rows of a frequent print
    return prints.join(names, "fp").select("doc_id", _hex(F.col("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str) -> np.ndarray:
    """The distinct hashes of a text's WIDTH-word shingles, sorted; a shorter text is one shingle."""
    import xxhash

    return np.unique(np.concatenate([np.zeros(0, "uint64"), *(np.array(x, "uint64") for x in shingle_chunks(text, WIDTH, xxhash.xxh64_intdigest))]))


def set_print(hashes: np.ndarray) -> int:
    """A set's fingerprint, a signed long: each bit is set if it is set in over half of the hashes."""
    total = np.unpackbits(hashes.astype(">u8").view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def set_key(hashes: np.ndarray) -> int:
    """The name of a set of shingles, a signed long."""
    import xxhash

    return (xxhash.xxh64_intdigest(hashes.tobytes(), SEED) ^ (1 << 63)) - (1 << 63)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A value for each of BANDS bands of ROWS min-hashes; equal values are alike in the whole band."""
    if not len(hashes):
        return np.zeros(0, "int64")
    least = np.full(BANDS * ROWS, (1 << 64) - 1, "uint64")
    for start in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[start : start + 1024] ^ _FLIP[:, None]) * _TIMES[:, None]).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype="uint64") * _TIMES[0]
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * _TIMES[1]
        out ^= out >> np.uint64(29)
    return out.view("int64")


@F.arrow_udf(LongType())
def set_key_udf(texts: pa.Array) -> pa.Array:
    """set_key of the texts' shingles."""
    return pa.array([set_key(shingle_set(s)) for s in strings(texts)], pa.int64())


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets of shingles is NEAR or more."""
    both = np.sort(np.concatenate((a, b)))
    both = int(np.count_nonzero(both[1:] == both[:-1]))
    return both * NEAR[1] >= NEAR[0] * (len(a) + len(b) - both)


@F.arrow_udf(BooleanType())
def near_udf(first: pa.Array, second: pa.Array) -> pa.Array:
    """near() of two columns of sets."""
    return pa.array([near(np.frombuffer(x.as_py(), "uint64"), np.frombuffer(y.as_py(), "uint64")) for x, y in zip(first, second)], pa.bool_())


def _shingled(docs: DataFrame) -> DataFrame:
    """(key, hashes) of each row's text."""

    @trimmed
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                sets = [shingle_set(s) for s in batch.column("text").slice(start, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "hashes"])

    return docs.select(whole().alias("text")).mapInArrow(shingle, "key long, hashes binary")


def near_links(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect all of sets (key, n, bands) that share a band and have similarity NEAR or more.

    Any value of bands names a shard of candidates: a component of fingerprints, or a band of min-hashes.

    First every set is compared with the smallest of each of its bands. Then, in the bands that hold more than one
    component, all pairs that aren't connected are compared, in pairs of pieces of at most about PART sets. A large
    group of near copies so needs few comparisons, and comparisons that fail have no rows.
    """
    shards = sets.select("key", "n", F.explode("bands").alias("shard"))
    heads = shards.groupBy("shard").agg(F.min(F.struct("key", "n")).alias("head"), F.count("*").alias("size")).where("size > 1").select("shard", "head").hint("merge")
    shared = materialise(shards.join(heads, "shard").select("shard", "key", "n", "head"), "shared")
    keys = materialise(shared.select("key").distinct(), "shared_keys")
    held = _shingled(docs).join(small(keys, keys.count()), "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes"))
    held = materialise(held, "shingles")

    def compared(pairs: DataFrame) -> DataFrame:
        rows = pairs.hint("merge").join(held.select(F.col("key").alias("a"), F.col("hashes").alias("first")), "a")
        rows = rows.hint("merge").join(held.select(F.col("key").alias("b"), F.col("hashes").alias("second")), "b")
        return materialise(rows.select("a", "b", near_udf("first", "second").alias("near")), "compared")

    #: sets whose sizes are too far apart can't be near
    may = lambda m, n: F.least(m, n) * NEAR[1] >= F.greatest(m, n) * NEAR[0]
    heads_met = shared.where((F.col("key") != F.col("head.key")) & may(F.col("n"), F.col("head.n")))
    one = compared(heads_met.select(F.col("head.key").alias("a"), F.col("key").alias("b")).distinct())
    roots = materialise(connected(one.where("near").select("a", "b")), "near_roots")
    with_root = shared.join(roots, F.col("key") == F.col("node"), "left").select("shard", "key", "n", "head", F.coalesce("root", "key").alias("group"))
    of_head = roots.select(F.col("node").alias("head_node"), F.col("root").alias("head_root"))
    placed = with_root.join(of_head, F.col("head.key") == F.col("head_node"), "left")
    placed = materialise(placed.select("shard", "key", "n", "group", F.coalesce("head_root", "head.key").alias("main")), "placed")
    apart = placed.where("group != main").select("shard").groupBy("shard").count().drop("count")
    rest = materialise(placed.join(apart, "shard").select("shard", "key", "group"), "apart")
    sizes = rest.groupBy("shard").agg(F.ceil(F.count("*") / PART).cast("int").alias("pieces"))
    own = rest.join(sizes, "shard").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    met = own.select("shard", "key", "group", "piece", other).select("shard", "key", "group", "piece", F.least("piece", "other").alias("lower"), F.greatest("piece", "other").alias("upper"))
    met = met.join(held, "key").join(sets.select("key", "bands"), "key")
    two = met.groupBy("shard", "lower", "upper").applyInPandas(_near_in_shard, "a long, b long")
    return one.where("near").select("a", "b").unionByName(two)


def _near_in_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that connect the near copies of two pieces of a shard; pairs that also share an earlier band are left to it."""
    keys, group, piece = (pdf[c].to_numpy() for c in ("key", "group", "piece"))
    group, hashes, band = group.copy(), [np.frombuffer(x, "uint64") for x in pdf["hashes"]], np.stack(pdf["bands"].to_list())
    sizes = np.array([len(x) for x in hashes])
    here = int(np.flatnonzero(band[0] == pdf["shard"].iat[0])[0])
    second = np.flatnonzero(piece == pdf["upper"].iat[0])
    pairs = []
    for i in np.flatnonzero(piece == pdf["lower"].iat[0]).tolist():
        may = second[(group[second] != group[i]) & (np.minimum(sizes[second], sizes[i]) * NEAR[1] >= np.maximum(sizes[second], sizes[i]) * NEAR[0])]
        may = may[(band[may] == band[i]).argmax(axis=1) == here]
        if pdf["lower"].iat[0] == pdf["upper"].iat[0]:
            may = may[may > i]
        for j in may.tolist():
            if group[i] != group[j] and near(hashes[i], hashes[j]):
                pairs.append((keys[i], keys[j]))
                group[group == group[j]] = group[i]
    release()
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _with_components(sets: DataFrame) -> DataFrame:
    """sets (key, n, fp, bands) with the component of their fingerprints as the first of their bands; sets without words have none."""
    owners = materialise(sets.where("n > 0").select("fp").distinct(), "set_prints")
    roots = materialise(connected(links(owners, owners.count())), "set_roots")
    named = sets.join(roots, F.col("fp") == F.col("node"), "left")
    own = F.array(F.xxhash64(F.lit("component"), F.coalesce("root", "fp")))
    return named.select("key", "n", F.when(F.col("n") > 0, F.concat(own, "bands")).otherwise(F.col("bands")).alias("bands"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, key, rows, group) of docs: key names the set of shingles, group what links of near copies connect."""
    bounded_batches(docs)
    rows = docs.select("doc_id", whole().alias("text"))

    @trimmed
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                sets = [shingle_set(s) for s in part.column("text").to_pylist()]
                made = pa.array([set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int32()), pa.array([set_print(x) for x in sets], pa.int64()), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", "key", "n", "fp", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    prints = materialise(rows.mapInArrow(sketch, f"doc_id {kind}, key long, n int, fp long, bands array<long>"), "sketches")
    sets = prints.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    sets = materialise(_with_components(materialise(sets, "printed")), "sets")
    roots = materialise(connected(near_links(docs, sets)), "roots")
    keys = prints.groupBy("doc_id", "key").agg(F.count("*").alias("rows"))
    return keys.join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "key", "rows", F.coalesce("root", "key").alias("group"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies, that of its smallest id, and all columns of docs.

    A null id comes after all others. An id whose rows have unlike texts is in several groups, and may stay for each; of
    rows equal in id and set of shingles the one with the smallest hash of its text stays.
    """
    groups = materialise(near_groups(docs), "groups")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key")).alias("first")
    leaders = groups.groupBy("group").agg(least).select("first.doc_id", "first.key")
    repeated = materialise(groups.groupBy("doc_id").agg(F.sum("rows").alias("rows")).where("rows > 1 or doc_id is null").select("doc_id"), "repeated")
    ids = small(repeated, repeated.count())
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), whole().alias("text"))
    same = F.col("id").eqNullSafe(F.col("doc_id"))
    # the id alone finds the row, unless it has several; only those are shingled once more
    alone = rows.join(leaders.join(ids.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left_anti"), same, "left_semi")
    other = rows.join(ids, same, "left_semi").withColumn("set", set_key_udf("text"))
    other = other.join(leaders, same & (F.col("set") == F.col("key")), "left_semi")
    first = F.row_number().over(Window.partitionBy("id", "set").orderBy(F.xxhash64("text"), F.xxhash64("doc")))
    return alone.select("doc.*").unionByName(other.withColumn("place", first).where("place = 1").select("doc.*"))
