"""Quality classifier: an interpolated modified Kneser-Ney model of character trigrams, trained on trusted text.

Trigrams of code points (three times 21 bits, packed exactly into a long) are counted in whole trusted texts, pre-added
in each task. Everything else of the training is joins and sums of count tables, dealt by n-gram, for all models at once: count trigrams, their
contexts' sums, how many contexts a bigram continues, the discounts from the counts of counts, and the interpolated
probabilities. A document's perplexity is that of all its characters, and comes from joins too:

1. Tasks read the documents in blocks of about BLOCK_CHARS and write the rows, with their block's number, and each
   block's distinct trigrams once, in buckets of the block.
2. The distinct trigrams of the corpus are joined to the model's tables, dealt by n-gram; a trigram that they lack is
   backed off to its bigram and to its last character.
3. The blocks' trigrams are joined to what comes out, and meet the block's rows, which the buckets keep in place.

The model that judges documents is trained on all trusted texts, the limits are cross-fitted: trusted texts are dealt to
FOLDS folds by a hash of the text, so copies lie in one, and each fold is judged by a model of the others' counts. Since a
short text says little, a text is judged with PRIOR more characters of the trained text's mean, and kept if the perplexity
so drawn to the mean is at most its language's QUANTILE over that language's trusted texts, found exactly by counting in
bins. Some texts that repeat well-formed words lie below the limit and pass.

Defined results: null and empty texts have no perplexity and aren't kept; a language without trusted texts, or a null
one, has the quantile over all trusted texts; where one fold holds all trusted texts, they judge themselves;
without any trusted text, all but empty texts are kept. A text of any length is read in slices. Equal texts get equal results; extra columns, whatever their names, are ignored by score() and kept by
kept_documents().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from framelake.llm.common import bounded_batches, bucketed, labelled, materialise, release, small, strings, trimmed, whole

#: Share of a language's held-out trusted texts that the limit must keep; the rest, 1 %, is what it may reject of them.
QUANTILE = 0.99
#: Parts of the trusted texts, each judged by a model of the others.
FOLDS = 5
#: Model 0 is of all trusted texts, model 1 + f of those outside fold f.
MODELS = FOLDS + 1
#: Characters of a block of texts that share a list of trigrams, and of a slice of a text.
BLOCK_CHARS, SLICE = 4 << 20, 1 << 20
#: Rows (key, logp) of the corpus' trigrams that may be broadcast (8 MB); more are joined by a shuffle.
KNOWN_ROWS = 500_000
#: Characters at the mean log probability of trusted text that are added to each text before it is judged.
PRIOR = 100
_BEGIN, _BITS = 0x110000, 21
_LOW, _LOW2 = (1 << _BITS) - 1, (1 << 2 * _BITS) - 1


def trigrams(text: str) -> np.ndarray:
    """Packed trigrams of a text, one for each character, with two begin marks before the first."""
    return np.concatenate([*slices(text), np.zeros(0, "int64")])


def slices(text: str) -> Iterator[np.ndarray]:
    """trigrams() of SLICE characters at a time."""
    before = np.array([_BEGIN, _BEGIN], "int64")
    for at in range(0, len(text), SLICE):
        c = np.concatenate((before, np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")))
        yield (c[:-2] << 2 * _BITS) | (c[1:-1] << _BITS) | c[2:]
        before = c[-2:]


def _add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys_, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys_, np.bincount(at, np.concatenate(counts)).astype("int64")


def count_trigrams(texts: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
    """(by, key, n): how often each trigram occurs in all whole texts of a value of by, an integer; without by, of all rows as 0."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, waiting = {}, 0, {}

        def press() -> None:
            nonlocal held, waiting
            for of, grams in waiting.items():
                keys, counts = found.get(of, ([], []))
                k, n = np.unique(np.concatenate(grams), return_counts=True)
                k, n = _add_up([*keys, k], [*counts, n])
                found[of] = [k], [n]
            held, waiting = 0, {}

        for batch in batches:
            for of, s in zip(batch.column("of").to_pylist(), strings(batch.column("text"))):
                for grams in slices(s):
                    waiting.setdefault(of, []).append(grams)
                    held += len(grams)
                    if held > 1_000_000:
                        press()
        press()
        for of, (keys, counts) in found.items():
            for at in range(0, len(keys[0]), 100_000):
                part = [pa.array(x[0][at : at + 100_000]) for x in (keys, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), of, "int32")), *part], ["of", "key", "n"])

    rows = texts.select((F.col(by) if by else F.lit(0)).cast("int").alias("of"), F.col(text).alias("text"))
    return rows.mapInArrow(count, "of int, key long, n long").groupBy("of", "key").agg(F.sum("n").alias("n")).withColumnRenamed("of", by or "of")


def _of(values: list[float]) -> Column:
    """The value of a row's model, whose number is in column of."""
    return F.array(*[F.lit(float(x)) for x in values])[F.col("of")]


def _discounts(counts: DataFrame, n: str) -> list[tuple[float, float, float]]:
    """Modified Kneser-Ney's three discounts of each model from how many n-grams occur once to four times."""
    seen = {(r["of"], r[n]): r["count"] for r in counts.where(F.col(n) <= 4).groupBy("of", n).count().collect()}
    return [_three([seen.get((of, i), 0) for i in (1, 2, 3, 4)]) for of in range(MODELS)]


def _three(seen: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = seen
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), i - 0.05) for d, i in zip(raw, (1, 2, 3)))


def _discounted(counts: DataFrame, n: str, context: Column) -> tuple[Column, DataFrame]:
    """What is left of a count, and (of, context, total, gamma) of each context."""
    d1, d2, d3 = (_of(d) for d in zip(*_discounts(counts, n)))
    off = F.when(F.col(n) == 1, d1).when(F.col(n) == 2, d2).otherwise(d3)
    sums = counts.groupBy("of", context.alias("context")).agg(F.sum(n).alias("total"), F.sum(off).alias("off"))
    return F.col(n) - off, sums.select("of", "context", "total", (F.col("off") / F.col("total")).alias("gamma"))


@dataclass
class Model:
    """Tables of natural logarithms: tri and bi (of, key, logp), ctx3 and ctx2 (of, context, logg), uni (of, key, logp).

    They hold the models of several sets of texts, numbered by of below MODELS; unknown has a value for each, entropy is that of model 0.
    """

    tri: DataFrame
    ctx3: DataFrame
    bi: DataFrame
    ctx2: DataFrame
    uni: DataFrame
    unknown: list[float]
    entropy: float


def train(trusted: DataFrame) -> Model | None:
    """Probabilities from trusted's column text; None without text."""
    return model_of(count_trigrams(trusted))


def model_of(trigram_counts: DataFrame) -> Model | None:
    """Probabilities from (of, key, n) of each model's trigrams; None without any. All models are made at once, by the same joins."""
    low, low2 = F.lit(_LOW), F.lit(_LOW2)
    c3 = materialise(trigram_counts.select("of", "key", "n"), "c3")
    c2 = materialise(c3.groupBy("of", F.col("key").bitwiseAND(low2).alias("key")).agg(F.count("*").alias("n")), "c2")
    c1 = materialise(c2.groupBy("of", F.col("key").bitwiseAND(low).alias("key")).agg(F.count("*").alias("n")), "c1")
    left1, _ = _discounted(c1, "n", F.lit(0))
    sums = {r["of"]: r for r in c1.groupBy("of").agg(F.count("*").alias("letters"), F.sum("n").alias("total"), F.sum(left1).alias("left")).collect()}
    if not sums:
        return None
    totals = [float(sums[of]["total"]) if of in sums else 1.0 for of in range(MODELS)]
    uniform = [(1 - sums[of]["left"] / sums[of]["total"]) / (sums[of]["letters"] + 1) if of in sums else 1.0 for of in range(MODELS)]
    uni = c1.select("of", "key", (left1 / _of(totals) + _of(uniform)).alias("p"))
    left2, ctx2 = _discounted(c2, "n", F.shiftright("key", _BITS))
    at2 = F.shiftright(F.col("key"), _BITS)
    bi = c2.withColumn("context", at2).join(ctx2, ["of", "context"]).withColumn("last", F.col("key").bitwiseAND(low))
    bi = bi.join(uni.withColumnRenamed("key", "last"), ["of", "last"])
    bi = materialise(bi.select("of", "key", (left2 / F.col("total") + F.col("gamma") * F.col("p")).alias("p")), "bi")
    left3, ctx3 = _discounted(c3, "n", F.shiftright("key", _BITS))
    tri = c3.withColumn("context", at2).join(ctx3, ["of", "context"]).withColumn("rest", F.col("key").bitwiseAND(low2))
    tri = tri.join(bi.withColumnRenamed("key", "rest"), ["of", "rest"])
    tri = materialise(tri.select("of", "key", "n", F.log(left3 / F.col("total") + F.col("gamma") * F.col("p")).alias("logp")), "tri")
    entropy = tri.where("of = 0").agg(-F.sum(F.col("n") * F.col("logp")) / F.sum("n")).first()[0]
    tri = tri.drop("n")
    logs = lambda df, name: materialise(df.select("of", "context", F.log("gamma").alias("logg")), name)
    ctx3, ctx2 = logs(ctx3, "ctx3"), logs(ctx2, "ctx2")
    log_p = lambda df, name: materialise(df.select("of", "key", F.log("p").alias("logp")), name)
    uni, bi = log_p(uni, "uni"), log_p(bi, "logbi")
    return Model(tri, ctx3, bi, ctx2, uni, [math.log(u) for u in uniform], entropy)


def _gram_blocks(docs: DataFrame, of: str | None = None) -> DataFrame:
    """Rows of two kinds: (block, row) with a row of docs as a struct, and (block, of, keys), a block's distinct trigrams.

    A block ends where a task has read BLOCK_CHARS of texts, so a common trigram has one entry in each block. Its rows have
    one number of a model, that of column of; 0 without that column.
    """
    rows = docs.select((F.col(of) if of else F.lit(0)).cast("int").alias("of"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    schema = StructType([StructField("block", LongType()), StructField("of", IntegerType()), StructField("row", rows.schema["row"].dataType), StructField("keys", ArrayType(LongType()))])
    names = schema.fieldNames()

    class Block:
        """The block of a model that is being filled."""

        def __init__(self, of: int, number: int) -> None:
            self.of, self.number, self.held, self.known, self.waiting = of, number, 0, np.zeros(0, "int64"), []

        def add(self, text: str) -> None:
            for grams in slices(text):
                self.waiting.append(np.unique(grams))
                self.held += len(grams)
                if len(self.waiting) >= 256:
                    self.press()

        def press(self) -> None:
            self.known, self.waiting = np.unique(np.concatenate((self.known, *self.waiting))), []

        def rows_of(self, rows: pa.StructArray) -> pa.RecordBatch:
            own = [pa.array(np.full(len(rows), x, kind)) for x, kind in ((self.number, "int64"), (self.of, "int32"))]
            return pa.RecordBatch.from_arrays([*own, rows, pa.nulls(len(rows), pa.list_(pa.int64()))], names)

        def keys_of(self, kind: pa.DataType) -> pa.RecordBatch:
            self.press()
            return pa.RecordBatch.from_arrays([pa.array([self.number]), pa.array([self.of], pa.int32()), pa.nulls(1, kind), pa.array([self.known], pa.list_(pa.int64()))], names)

    @trimmed
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, blocks, kind = count(TaskContext.get().partitionId() << 24), {}, None
        for batch in batches:
            kind, models = batch.column("row").type, batch.column("of").to_numpy()
            for of in np.unique(models).tolist():
                rows, begun = batch.column("row"), 0
                if (own := models == of).sum() < len(own):
                    rows = rows.filter(pa.array(own))
                block = blocks.get(of) or blocks.setdefault(of, Block(of, next(numbers)))
                for at, text in enumerate(strings(rows.field("text"))):
                    block.add(text or "")
                    if block.held > BLOCK_CHARS:
                        yield block.rows_of(rows.slice(begun, at + 1 - begun))
                        yield block.keys_of(kind)
                        block, begun = blocks.setdefault(of, Block(of, next(numbers))), at + 1
                        block, begun = Block(of, next(numbers)), at + 1
                        blocks[of] = block
                if begun < len(rows):
                    yield block.rows_of(rows.slice(begun))
        for block in blocks.values():
            if block.held:
                yield block.keys_of(kind)

    return rows.mapInArrow(split, schema)


def log_probabilities(keys: DataFrame, model: Model) -> DataFrame:
    """(of, key, logp) of each model's distinct trigrams: stored, else backed off, by joins to the tables."""
    rows = keys.join(model.tri.withColumnRenamed("logp", "p3"), ["of", "key"], "left")
    rows = rows.withColumn("context", F.shiftright("key", _BITS)).join(model.ctx3.withColumnRenamed("logg", "g3"), ["of", "context"], "left")
    rows = rows.withColumn("two", F.col("key").bitwiseAND(F.lit(_LOW2))).join(model.bi.select("of", F.col("key").alias("two"), F.col("logp").alias("p2")), ["of", "two"], "left")
    rows = rows.withColumn("mid", F.col("context").bitwiseAND(F.lit(_LOW))).join(model.ctx2.select("of", F.col("context").alias("mid"), F.col("logg").alias("g2")), ["of", "mid"], "left")
    rows = rows.withColumn("one", F.col("key").bitwiseAND(F.lit(_LOW))).join(model.uni.select("of", F.col("key").alias("one"), F.col("logp").alias("p1")), ["of", "one"], "left")
    back = F.coalesce("g3", F.lit(0.0)) + F.coalesce("p2", F.coalesce("g2", F.lit(0.0)) + F.coalesce("p1", _of(model.unknown)))
    return rows.select("of", "key", F.coalesce("p3", back).alias("logp"))


def _mean_log(text: str, keys: np.ndarray, logp: np.ndarray) -> float:
    return sum(float(logp[np.searchsorted(keys, grams)].sum()) for grams in slices(text)) / len(text)


def with_perplexity(docs: DataFrame, model: Model, of: str | None = None) -> DataFrame:
    """(row, perplexity): docs' rows as structs and the perplexities of their whole texts, by joins of counted trigrams.

    Column of has the number of the model that judges a row; without it model 0 judges all.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = bucketed(_gram_blocks(docs, of), buckets, "block")
    grams = blocks.where("keys is not null").select("block", "of", F.explode("keys").alias("key"))
    known = materialise(log_probabilities(grams.select("of", "key").distinct(), model), "known")
    known, on = (known, ["of", "key"]) if of else (known.drop("of"), ["key"])
    values = grams.join(small(known, known.count(), KNOWN_ROWS), on).select(F.col("block").alias("in_block"), "key", "logp")
    rows = blocks.where("row is not null").select("block", "row")

    def add_up(values: pa.Table, rows: pa.Table) -> pa.Table:
        keys, logp = values["key"].to_numpy(), values["logp"].to_numpy()
        order = np.argsort(keys)
        keys, logp = keys[order], logp[order]
        found = [math.exp(-_mean_log(s, keys, logp)) if s else None for c in rows["row"].chunks for s in strings(c.field("text"))]
        release()
        return pa.table([rows["row"], pa.array(found, pa.float64())], ["row", "perplexity"])

    schema = StructType([StructField("row", rows.schema["row"].dataType), StructField("perplexity", DoubleType())])
    return values.groupBy("in_block").cogroup(rows.groupBy("block")).applyInArrow(add_up, schema)


def judged(model: Model, perplexity: Column, characters: Column) -> Column:
    """The perplexity drawn to the trained text's by PRIOR characters of it."""
    return F.exp((F.log(perplexity) * characters + F.lit(PRIOR * model.entropy)) / (characters + PRIOR))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> tuple[dict[str, float], float]:
    """Per language, and over all, the least of scored's values (lang, judged) that has the share quantile at or below it.

    Counts by bins of ln judged say which bin holds the rank; only that bin's values are counted one by one.
    """
    group = F.explode(F.array(F.struct(F.lit(True).alias("every"), F.lit("").alias("lang")), F.struct(F.lit(False).alias("every"), F.col("lang")))).alias("g")
    each = scored.where("judged is not null").select(F.floor(F.log("judged") * 1000).alias("bin"), "judged", group)
    each = materialise(each.select("g.every", "g.lang", "bin", "judged").where("lang is not null").groupBy("every", "lang", "bin", "judged").agg(F.count("*").alias("n")), "judged")

    def ranked(counts: DataFrame, value: str) -> DataFrame:
        by = Window.partitionBy("every", "lang")
        upto = by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(by))

    bins = ranked(each.groupBy("every", "lang", "bin").agg(F.sum("n").alias("n")), "bin").withColumn("rank", F.ceil(F.col("total") * F.lit(quantile)))
    bins = materialise(bins.where("upto >= rank and upto - n < rank").select("every", "lang", "bin", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")), "bins")
    inside = ranked(each.join(F.broadcast(bins) if bins.count() < 100_000 else bins, ["every", "lang", "bin"]), "judged")
    found = inside.where("upto >= rank and upto - n < rank").select("every", "lang", "judged").collect()
    return {r["lang"]: r["judged"] for r in found if not r["every"]}, next((r["judged"] for r in found if r["every"]), math.inf)


def limit_of(limits: tuple[dict[str, float], float], lang: Column) -> Column:
    by = F.create_map(*[F.lit(x) for kv in sorted(limits[0].items()) for x in kv]) if limits[0] else F.create_map().cast("map<string,double>")
    return F.coalesce(F.try_element_at(by, F.coalesce(lang, F.lit(""))), F.lit(limits[1]))


def fit(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> tuple[Model, tuple[dict[str, float], float]] | None:
    """The model and the limits from docs that are labelled quality 1; None without their text."""
    bounded_batches(docs)
    trusted = labelled(docs, labels, "quality", learn_fold=False).where("label = 1 and text != ''")
    trusted = materialise(trusted.select("doc_id", "lang", "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).alias("fold")), "trusted")
    counts = materialise(count_trigrams(trusted, by="fold"), "counts")
    folds = sorted(r[0] for r in counts.select("fold").distinct().collect())
    if not folds:
        return None
    takes = lambda of: (of == 0) | (of != F.col("fold") + 1) | F.lit(len(folds) == 1)
    numbers = F.array(*[F.lit(of) for of in (0, *(f + 1 for f in folds))])
    model = model_of(counts.select(F.explode(F.filter(numbers, takes)).alias("of"), "key", "n").groupBy("of", "key").agg(F.sum("n").alias("n")))
    scored = with_perplexity(trusted.withColumn("of", (F.col("fold") + 1).cast("int")), model, "of")
    seen = scored.select("row.lang", judged(model, F.col("perplexity"), F.length("row.text")).alias("judged"))
    return model, thresholds(materialise(seen, "trusted_judged"), quantile)


def score(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, judged, limit, keep) of each row."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), whole().alias("text"))
    fitted = fit(docs, labels, quantile)
    if fitted is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", none.alias("perplexity"), none.alias("judged"), F.lit(math.inf).alias("limit"), (F.col("text") != "").alias("keep"))
    model, limits = fitted
    scored = with_perplexity(rows, model).select("row.doc_id", "row.lang", "perplexity", judged(model, F.col("perplexity"), F.length("row.text")).alias("judged"))
    scored = scored.withColumn("limit", limit_of(limits, F.col("lang")))
    return scored.withColumn("keep", F.coalesce(F.col("judged") <= F.col("limit"), F.lit(False)))


def kept_documents(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs without the rejected ones, with all columns of docs."""
    fitted = fit(docs, labels, quantile)
    if fitted is None:
        return docs.where(whole() != "")
    model, limits = fitted
    seen = judged(model, F.col("perplexity"), F.length("row.text"))
    return with_perplexity(docs, model).where(seen <= limit_of(limits, F.col("row.lang").cast("string"))).select("row.*")
