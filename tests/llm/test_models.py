"""Language identification and toxicity against the same sums in plain NumPy, and chat ids that don't equal themselves."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.llm import chat_format, langid, queries, toxicity
from tests.conftest import SF

U64 = (1 << 64) - 1


def learnt(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


def test_language_equals_plain_tf_idf_centroids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").collect()
    assert max(Counter(r.lang for r in docs).values()) < langid.SAMPLE  # every training row is in the sample

    def bins(text):
        c = [32, *map(ord, text.lower()), 32]
        two = [(a * (1 << 21) + b) & U64 for a, b in zip(c, c[1:])]
        three = [(a * 0xC2B2AE3D27D4EB4F + b) & U64 for a, b in zip(two, c[2:])]
        return Counter((x * 0x9E3779B97F4A7C15 + k & U64) >> 52 for k, xs in ((1, c), (2, two), (3, three)) for x in xs)

    counts = {r.doc_id: bins(r.text) for r in docs if r.text and any(ch.isalpha() for ch in r.text)}
    train = [r for r in docs if r.lang is not None and learnt(r.doc_id) and r.doc_id in counts]
    df = Counter(b for r in train for b in counts[r.doc_id])
    idf = np.array([math.log((1 + len(train)) / (1 + df[b])) + 1 for b in range(langid.DIMENSIONS)])

    def vector(i):
        v = np.zeros(langid.DIMENSIONS)
        for b, n in counts[i].items():
            v[b] = (1 + math.log(n)) * idf[b]
        return v / np.linalg.norm(v)

    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where(~F.crc32(F.col("doc_id").cast("string").cast("binary")).isNull()).where(langid.fold() != 1))
    assert np.allclose(model["idf"], idf, rtol=1e-6)
    by = defaultdict(list)
    for r in train:
        by[r.lang].append(vector(r.doc_id))
    for lang, own in by.items():
        centres = model["centres"][model["langs"] == lang].astype("float64")
        near = (np.array(own) @ centres.T).argmax(axis=1)
        for k, centre in enumerate(centres):  # a centre is the direction of the vectors nearest to it
            mean = np.array(own)[near == k].sum(axis=0)
            assert centre @ mean / np.linalg.norm(mean) > 0.999
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    for r in docs:
        if r.doc_id not in counts:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        cosines = model["centres"].astype("float64") @ vector(r.doc_id)
        assert got[r.doc_id].score == pytest.approx(cosines.max(), abs=1e-5) and got[r.doc_id].held_out == (not learnt(r.doc_id))
        assert cosines[model["langs"] == got[r.doc_id].lang_pred].max() > cosines.max() - 1e-5


def plain_newton(x, y, change):
    """The minimum of the loss by dense Newton steps."""
    n, m = x.shape
    x1 = np.hstack((x, np.ones((n, 1))))
    fixed = np.zeros((m + 1, m + 1))
    fixed[:m, :m] = toxicity.RIDGE * np.eye(m) + 2 * toxicity.COUNTERFACTUAL / max(1, len(change)) * change.T @ change
    w = np.zeros(m + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1.T * (p * (1 - p) / n)) @ x1 + fixed + 1e-8 * np.eye(m + 1), x1.T @ (p - y) / n + fixed @ w)
        w -= step * min(1, 5 / max(1e-12, abs(step).max()))
        if abs(step).max() < 1e-4:
            break
    return w[:m], w[m]


def test_sparse_steps_equal_dense_ones():
    rng = np.random.default_rng(4)
    x = (rng.random((400, 90)) < 0.1).astype(float)
    y = (x[:, 0] + x[:, 1] + 0.3 * rng.standard_normal(400) > 0.5).astype(float)
    change = x[:50] - np.roll(x[:50], 1, axis=1)
    got, want = toxicity.fit_weights(x, y, change), plain_newton(x, y, change)
    assert np.allclose(got[0], want[0], atol=1e-6) and got[1] == pytest.approx(want[1], abs=1e-6)


def test_toxicity_equals_plain_counts_and_newton(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None}
    words = {r.doc_id: set(re.findall(r"\w+", (r.text or "").lower())) for r in docs}
    features = lambda ws: {f for w in ws for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) >= k), *("*" + w[-k:] for k in (4, 5) if len(w) >= k)]}
    train = sorted((toxic[i], i) for i in words if i in toxic and learnt(i))
    n1 = sum(t for t, _ in train)
    n0 = len(train) - n1
    assert max(n1, n0) < toxicity.SAMPLE
    held = [Counter(f for t, i in train if t == label for f in features(words[i])) for label in (0, 1)]

    def clear(f):
        a, b = held[1][f], held[0][f]
        p = (a + b + 0.5) / (n1 + n0 + 1)
        return a >= min(toxicity.LEAST, n1) and a / n1 >= 2 * b / n0 and (a / n1 - b / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) >= toxicity.CLEAR

    chosen = sorted(f for f in held[1] if clear(f))
    x = np.array([[f in features(words[i]) for f in chosen] for _, i in train], float).reshape(len(train), -1)
    swapped = [{toxicity.SWAP.get(w, w) for w in words[i]} for _, i in train]
    moved = [k for k, (_, i) in enumerate(train) if any(w in toxicity.SWAP for w in words[i])]
    change = np.array([x[k] - [f in features(swapped[k]) for f in chosen] for k in moved]).reshape(len(moved), len(chosen))
    weights, base = plain_newton(x, np.array([t for t, _ in train], float), change)
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, SF).collect()}
    for i, ws in words.items():
        logit = base + sum(w for f, w in zip(chosen, weights) if f in features(ws))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-6)
        assert got[i].held_out == (not learnt(i)) and got[i].predicted == (got[i].score >= 0.7)


def test_all_clear_features_are_kept(spark):
    texts = [(i, " ".join(f"bad{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}q{k}" for k in range(1500)), 1) for i in range(60)] + [(100 + i, "plain text here", 0) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string, label int"))
    assert len(model["features"]) > 1500 and np.isfinite(model["weights"]).all()


def test_nan_ids_are_one_conversation(spark):
    rows = [(float("nan"), t, "user" if t % 2 == 0 else "assistant", f"says {t}") for t in range(4)] + [(None, 0, "assistant", "none"), (None, 1, "user", "none"), (1.5, 0, "user", "x")]
    got = chat_format.read_back(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id double, turn int, role string, text string"))).collect()
    assert sorted((str(r["conv_id"]), r["n_turns"], r["loss_chars"]) for r in got) == [("1.5", 1, 0), ("None", 2, 4), ("nan", 4, 12)]
