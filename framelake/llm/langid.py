"""Language ID by nearest centroids of TF-IDF n-gram vectors.

A text becomes counts of its lower-cased character 1- to 3-grams in DIMENSIONS hashed bins, damped by 1 + ln, weighted
by inverse document frequencies and scaled to length one. Each language has up to CLUSTERS centroids, found by
spherical k-means over its sampled vectors; a text gets the language of the centroid with the largest cosine. It is
rejected (column rejected; the nearest language still stands) if that cosine is below the language's limit, the
REJECT quantile of the cosines of its own sampled texts.

Document frequencies cover all training texts. The centroids are fitted on a bounded sample: about SAMPLE texts per
language, those with the smallest hashes of id and text, the same in each run.

Defined results: a text that is null or without a letter is `und` with score 0; null languages aren't learned; without
any learned language every text is `und`. Every language is learned, however few rows it has. Repeated rows get equal
results; extra columns, whatever their names, are ignored; an empty table gives an empty result. A very long text is one
row of counts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import bounded_batches, fold, materialise, small, strings, trimmed, whole

DIMENSIONS, CLUSTERS, SAMPLE, REJECT = 4096, 3, 800, 0.001
#: Centroids that go to a task at once (16 KB each); more are compared in further passes over the rows.
CENTRES = 3000
#: What two products of the same vectors may differ by.
ROUNDING = 1e-6


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins and counts of a text's n-grams."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
    c = np.concatenate(([32], c, [32])).astype("uint64")
    mix = lambda x, k: ((x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) >> np.uint64(52)).astype("int64")
    two = c[:-1] * np.uint64(1 << 21) + c[1:]
    three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:]
    counts = np.bincount(np.concatenate((mix(c, 1), mix(two, 2), mix(three, 3))), minlength=DIMENSIONS)
    bins = np.flatnonzero(counts)
    return bins, counts[bins]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(unicodedata.category(c)[0] == "L" for c in text)


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    bins, counts = grams(text)
    out = np.zeros(DIMENSIONS, "float32")
    out[bins] = (1 + np.log(counts)) * idf[bins]
    return out / (np.linalg.norm(out) or 1)


def centroids(vectors: np.ndarray, k: int = CLUSTERS, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with farthest-first starts; centroids of length one and each vector's largest cosine."""
    starts = [0]
    for _ in range(min(k, len(vectors)) - 1):
        starts.append(int((vectors @ vectors[starts].T).max(axis=1).argmin()))
    centres = vectors[sorted(set(starts))]
    for _ in range(rounds):
        near = (vectors @ centres.T).argmax(axis=1)
        sums = np.stack([vectors[near == i].sum(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype("float32"), (vectors @ centres.T).max(axis=1)


def fit(docs: DataFrame) -> dict:
    """Model from docs' text and lang: idf, centres, langs and limits of the centres."""
    bounded_batches(docs)
    known = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = materialise(known.groupBy("lang").agg(F.least(F.lit(1.0), SAMPLE / F.count("*")).alias("share")), "languages")
    lot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = known.join(small(counts, counts.count()), "lang").select("lang", "text", (lot < F.col("share")).alias("sampled"))

    @trimmed
    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(DIMENSIONS, "int64"), 0
        schema = pa.schema([("lang", pa.string()), ("bins", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
        for batch in batches:
            out = []
            for text, lang, sampled in zip(strings(batch.column("text")), *(batch.column(c).to_pylist() for c in ("lang", "sampled"))):
                if not has_letter(text):
                    continue
                bins, n = grams(text)
                seen[bins] += 1
                texts += 1
                if sampled:
                    out.append({"lang": lang, "bins": bins, "counts": n})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if texts:  # document frequencies of this task; bin DIMENSIONS counts its texts
            yield pa.RecordBatch.from_pylist([{"lang": None, "bins": np.arange(DIMENSIONS + 1), "counts": np.append(seen, texts)}], schema)

    seen = materialise(rows.mapInArrow(featurise, "lang string, bins array<int>, counts array<long>"), "vectors")
    sums = seen.where("lang is null").select(F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("x.bins").agg(F.sum("x.counts").alias("n")).toPandas()
    df = np.zeros(DIMENSIONS + 1)
    df[sums["bins"]] = sums["n"]
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype("float32")

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(size=pdf["bins"].map(len)).sort_values("size", kind="stable")
        vectors = np.zeros((len(pdf), DIMENSIONS), "float32")
        for v, bins, n in zip(vectors, pdf["bins"], pdf["counts"]):
            v[bins] = (1 + np.log(n)) * idf[bins]
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        vectors = vectors[np.lexsort(vectors[:, :8].T)]
        centres, near = centroids(vectors)
        return pd.DataFrame({"lang": pdf["lang"].iat[0], "centre": list(centres), "bound": float(np.quantile(near, REJECT))})

    found = seen.where("lang is not null").groupBy("lang").applyInPandas(cluster, "lang string, centre array<float>, bound double").orderBy("lang").toPandas()
    return {"langs": found["lang"].to_numpy(object), "idf": idf, "centres": np.stack(found["centre"].to_list()) if len(found) else np.zeros((0, DIMENSIONS)), "limits": found["bound"].to_numpy()}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row, from its text alone."""
    bounded_batches(docs)
    rows = docs.select("doc_id", (fold() == 1).alias("held_out"), whole().alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("rejected"))
    schema = rows.schema

    def nearest_of(centres: np.ndarray, langs: np.ndarray, limits: np.ndarray, idf: np.ndarray):
        @trimmed
        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = [list(x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang_pred", "score", "rejected")))]
                for so_far, text in zip(best, strings(batch.column("text"))):
                    if has_letter(text):
                        cosines = centres @ vector(text, idf)
                        i = int(cosines.argmax())
                        if so_far[1] is None or cosines[i] > so_far[1]:
                            so_far[:] = langs[i], float(cosines[i]), bool(cosines[i] < limits[i] - ROUNDING)
                made = (pa.array([x[k] for x in best], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "text")), *made], schema.names)

        return nearest

    for at in range(0, len(model["centres"]), CENTRES):
        own = slice(at, at + CENTRES)
        rows = rows.mapInArrow(nearest_of(model["centres"][own].astype("float32"), model["langs"][own], model["limits"][own], model["idf"]), schema)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
    return rows.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"), F.coalesce("rejected", F.lit(True)).alias("rejected"))


def identify(docs: DataFrame) -> DataFrame:
    """predict() by a model of docs' rows outside the held-out fold."""
    return predict(docs, fit(docs.where(fold() != 1)))
