"""Toxicity by a counterfactually regularised classifier.

A text's features are its distinct lower-cased words, their beginnings and their ends. How many toxic and other texts
hold a feature is counted over all labelled training texts, and for all features; those that are clearly more frequent
in toxic ones are kept, all of them. A logistic regression on them is fitted on a bounded sample, about SAMPLE
texts of each label, those with the smallest hashes, the same in each run. Its loss has, besides a ridge, the squared
change of a text's logit when each identity term in it is swapped for another of its group, so that the mere mention of
a group can't carry weight.

The distinct words of labelled texts are written once; counts and sample are read from there. A text of any length is
one set of words.

Defined results: null texts are empty and have the score of a text without features; with no toxic or no other
training text every score is the toxic share; an id that labels repeat has its smallest label; an empty table gives an
empty result. Repeated rows get equal results; extra columns, whatever their names, are ignored by score()
and kept by clean_documents().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, fold, labelled, materialise, release, strings, trimmed, whole

SAMPLE, CUT = 4000, 0.7
#: Words whose features a task remembers before it starts anew.
KNOWN = 400_000
#: Toxic texts that must hold a feature.
LEAST = 3
#: Standard errors that a feature's share in toxic texts exceeds that in others by.
CLEAR = 4.5
RIDGE, COUNTERFACTUAL = 3e-6, 1.0
#: Terms of which each may be swapped for the next of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "mexican", "chinese", "indian"), ("immigrants", "natives"), ("immigrant", "native"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}
_WORDS = re.compile(r"\w+")


def word_features(word: str) -> tuple[str, ...]:
    """The word itself, its beginnings of 4 to 6 and its ends of 4 and 5 letters."""
    n = len(word)
    return (word, *(f"{word[:k]}*" for k in (4, 5, 6) if n >= k), *(f"*{word[-k:]}" for k in (4, 5) if n >= k))


def words_of(text: str) -> set[str]:
    return set(_WORDS.findall(text.lower()))


class Index(dict):
    """word -> numbers of its features among the model's; filled as words come, emptied when large."""

    def __init__(self, features: list[str]) -> None:
        super().__init__()
        self.number = {f: i for i, f in enumerate(features)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > KNOWN:
            self.clear()
        self[word] = out = tuple(self.number[f] for f in word_features(word) if f in self.number)
        return out

    def of(self, words: Iterable[str]) -> set[int]:
        return {i for w in words for i in self[w]}


def _words(train: DataFrame) -> DataFrame:
    """(doc_id, label, lot, words) of train's rows: their distinct words, and a number from 0 to 1 by which some are drawn."""
    rows = train.where("label in (0, 1)").select("doc_id", "label", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("lot"))

    @trimmed
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                words = pa.array([sorted(words_of(t)) for t in part.column("text").to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "label", "lot")), words], ["doc_id", "label", "lot", "words"])

    return rows.mapInArrow(split, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, lot double, words array<string>")


def _counts(rows: DataFrame) -> DataFrame:
    """(feature, n1, n0): toxic and other rows (label, words) that hold each feature."""

    @trimmed
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for label, own in enumerate(seen):
                n = np.fromiter(own.values(), "int64", len(own))
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(n * label), pa.array(n * (1 - label))], ["feature", "n1", "n0"])
                own.clear()

        for batch in batches:
            for words, label in zip(strings(batch.column("words"), 64), batch.column("label").to_pylist()):
                seen[label].update({f for w in words for f in word_features(w)})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield from out()
        yield from out()

    return rows.select("words", "label").mapInArrow(count, "feature string, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def clearest(train: DataFrame, n1: int, n0: int) -> list[str]:
    """All features of train's n1 toxic and n0 other rows (label, words) that are clearly more frequent in toxic ones."""
    rows = _counts(train).where(F.col("n1") >= min(LEAST, n1))
    p1, p0, p = F.col("n1") / n1, F.col("n0") / n0, (F.col("n1") + F.col("n0") + 0.5) / (n1 + n0 + 1)
    rows = rows.withColumn("z", (p1 - p0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))
    return sorted(r["feature"] for r in rows.where((F.col("z") >= CLEAR) & (p1 >= 2 * p0)).select("feature").collect())


class Sparse:
    """A matrix by its entries (row, column, value)."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> None:
        self.rows, self.columns, self.values, self.shape = rows, columns, values, shape

    @classmethod
    def of(cls, lists: Sequence[Sequence[int]], width: int) -> Sparse:
        """Ones at each row's columns."""
        lengths = [len(x) for x in lists]
        columns = np.concatenate([np.asarray(x, "int64") for x in lists]) if lengths else np.zeros(0, "int64")
        return cls(np.repeat(np.arange(len(lengths)), lengths), columns.astype("int64"), np.ones(len(columns)), (len(lengths), width))

    @classmethod
    def from_dense(cls, x: np.ndarray | Sparse) -> Sparse:
        return x if isinstance(x, Sparse) else cls(*np.nonzero(x), x[np.nonzero(x)], x.shape)

    def minus(self, other: Sparse) -> Sparse:
        both = (np.concatenate((a, b)) for a, b in ((self.rows, other.rows), (self.columns, other.columns), (self.values, -other.values)))
        return Sparse(*both, self.shape)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * v[self.columns], self.shape[0])

    def down(self, v: np.ndarray) -> np.ndarray:
        """The transposed matrix times v."""
        return np.bincount(self.columns, self.values * v[self.rows], self.shape[1])


def _solved(curve, b: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The solution of curve(x) = b by conjugate gradients, scale being curve's diagonal."""
    x, r = np.zeros_like(b), b.copy()
    z = r / scale
    d, old = z.copy(), r @ z
    for _ in range(10 * len(b)):
        if np.abs(r).max() <= 1e-12 + 1e-9 * np.abs(b).max():
            break
        q = curve(d)
        step = old / (d @ q)
        x, r = x + step * d, r - step * q
        z = r / scale
        new = r @ z
        d, old = z + (new / old) * d, new
    return x


def fit_weights(x: Sparse | np.ndarray, y: np.ndarray, change: Sparse | np.ndarray, ridge: float = RIDGE, counterfactual: float = COUNTERFACTUAL, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Newton's method for the logistic loss with a ridge and the mean squared change of logits.

    Steps are solved by conjugate gradients, so memory grows with the entries and not with the square of the features.
    """
    x, change = Sparse.from_dense(x), Sparse.from_dense(change)
    n, m = x.shape
    pull, small = 2 * counterfactual / max(1, change.shape[0]), 1e-8
    squares = np.bincount(change.columns, change.values**2, m)
    # an entry that is swapped into itself stands twice, with both signs: its square is that of the sum
    if len(change.rows):
        cells, at = np.unique(change.rows * m + change.columns, return_inverse=True)
        squares = np.bincount(cells % m, np.bincount(at, change.values) ** 2, m)
    w, b = np.zeros(m), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + b, -30, 30)))
        slope = np.append(x.down(p - y) / n + ridge * w + pull * change.down(change.times(w)), (p - y).mean())
        weight = p * (1 - p) / n

        def curve(v: np.ndarray, weight=weight) -> np.ndarray:
            moved = weight * (x.times(v[:m]) + v[m])
            return np.append(x.down(moved) + ridge * v[:m] + pull * change.down(change.times(v[:m])), moved.sum()) + small * v

        step = _solved(curve, slope, np.append(x.down(weight) + ridge + pull * squares, weight.sum()) + small)
        move = step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        w, b = w - move[:m], b - move[m]
        if np.abs(step).max() < 1e-4:
            break
    return w, float(b)


def fit(train: DataFrame) -> dict:
    """features, weights and intercept from train's text and label (1: toxic)."""
    bounded_batches(train)
    train = materialise(_words(train), "words")
    sizes = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    share = n1 / max(1, n0 + n1)
    plain = {"features": [], "weights": np.zeros(0), "intercept": math.log(max(share, 1e-6) / max(1 - share, 1e-6))}
    if not n1 or not n0:
        return plain
    features = clearest(train, n1, n0)
    if not features:
        return plain
    picked = train.where(F.col("lot") < F.when(F.col("label") == 1, min(1.0, SAMPLE / n1)).otherwise(min(1.0, SAMPLE / n0)))

    @trimmed
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(features)
        for batch in batches:
            own, swapped = [], []
            for words in strings(batch.column("words"), 64):
                own.append(sorted(index.of(words)))
                swapped.append(sorted(index.of({SWAP.get(x, x) for x in words})) if not SWAP.keys().isdisjoint(words) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.int32()))], ["doc_id", "label", "own", "swapped"])

    kind = train.schema["doc_id"].dataType.simpleString()
    rows = picked.select("doc_id", "label", "words").mapInArrow(featurise, f"doc_id {kind}, label int, own array<int>, swapped array<int>").orderBy("label", "doc_id").toPandas()
    changed = rows[rows["swapped"].notna()]
    y = rows["label"].to_numpy("float64")
    if not 0 < y.sum() < len(y):
        return plain
    of = lambda lists: Sparse.of(list(lists), len(features))
    weights, intercept = fit_weights(of(rows["own"]), y, of(changed["own"]).minus(of(changed["swapped"])))
    # the sample holds more toxic texts than the corpus
    intercept += math.log(n1 / n0) - math.log(y.sum() / (len(y) - y.sum()))
    return {"features": features, "weights": weights, "intercept": intercept}


def score_udf(model: dict):
    """A column function text -> score from 0 to 1; the model, its features and weights, goes along with it."""

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, weights, base = Index(model["features"]), model["weights"].tolist(), model["intercept"]
        for batch in texts:
            logits = np.array([base + sum([weights[i] for i in sorted(index.of(words_of(t)))]) for t in strings(batch)], "float64")
            yield pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))
        release(0)

    return lambda text: score(text)


def score(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row, by a model of the labelled rows outside the held-out fold."""
    model = fit(labelled(docs, labels, "toxic", learn_fold=True))
    rows = docs.select("doc_id", (fold() == 1).alias("held_out"), score_udf(model)(whole()).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def clean_documents(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """docs whose score is below cut, with all columns of docs."""
    model = fit(labelled(docs, labels, "toxic", learn_fold=True))
    return docs.where(score_udf(model)(whole()) < cut)
