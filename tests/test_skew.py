"""Exact percentiles under skew, and associative scans of one long key over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import metrics, selection, sequence


@pytest.mark.parametrize("accuracy", [20_000, 100])
def test_percentiles_of_skewed_keys(spark, monkeypatch, accuracy):
    monkeypatch.setattr(selection, "COUNTED", 0 if accuracy == 100 else 13_000)
    rng = np.random.default_rng(1)
    data = {"out": [*rng.uniform(0, 10, 30_000).tolist(), 1e9], "same": [5.0] * 9000 + [7.0], "one": [3.0], "two": [1.0, 4.0], "ties": rng.integers(0, 4, 5000).astype(float).tolist(), "neg": (-rng.exponential(1, 3001)).tolist()}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("one", None), ("nan", float("nan")), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.01, 0.5, 0.9, 0.999, 1.0]
    got = {r["k"]: (r["n"], r["q"]) for r in selection.percentiles(df, "v", shares, "k", accuracy=accuracy).collect()}
    assert set(got) == set(data)
    low = {r["k"]: r["q"] for r in selection.percentiles(df, "v", [0.25, 0.5], "k", lower=True, accuracy=accuracy).collect()}
    for k, vs in data.items():
        assert got[k][0] == len(vs) and got[k][1] == pytest.approx(np.percentile(vs, [100 * s for s in shares]).tolist(), rel=1e-12, abs=1e-12)
        ordered = sorted(vs)
        assert low[k] == [ordered[max(0, int(np.ceil(p * len(vs))) - 1)] for p in (0.25, 0.5)]
    assert selection.percentiles(df.where("k = 'ties'"), "v", [0.5]).first()["q"] == [float(np.median(data["ties"]))]
    monkeypatch.setattr(selection, "COUNTED", 10**9)
    for r in selection.percentiles(df, "v", shares, "k").collect():
        assert r["q"] == pytest.approx(got[r["k"]][1], rel=1e-12, abs=1e-12)
    assert selection.percentiles(df.limit(0), "v", [0.5], "k").count() == 0


def test_an_outlier_leaves_no_task_with_more_than_a_bracket(spark):
    """What the last window sorts of 200,000 values and one a hundred million times as large."""
    df = spark.range(200_000).select((F.rand(3) * 10).alias("v")).unionByName(spark.createDataFrame([(1e9,)], "v double"))
    df = selection.materialise(df)
    out = selection.percentiles(df, "v", [0.5, 0.99])
    out.collect()
    plan, sorted_rows = [out._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            plan.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            plan.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            sorted_rows.append(node.metrics().apply("shuffleRecordsWritten").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    assert sorted_rows and max(sorted_rows) < 2000
    values = [r[0] for r in df.collect()]
    assert out.first()["q"] == pytest.approx(np.percentile(values, [50, 99]).tolist())


def test_robust_flags_use_exact_medians(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k in (1, 2) for v in rng.normal(k, 1, 501)] + [(1, 1e8)]
    got = metrics.robust_flags(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()
    for k in (1, 2):
        own = sorted(v for i, v in rows if i == k)
        med = own[(len(own) - 1) // 2]
        away = sorted(abs(v - med) for v in own)
        assert {r["med"] for r in got if r["k"] == k} == {med} and {r["mad"] for r in got if r["k"] == k} == {away[(len(away) - 1) // 2]}


def test_one_key_is_scanned_by_many_tasks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        rng = np.random.default_rng(3)
        rows = [("hot", i, float(rng.normal()), bool(rng.random() < 0.002)) for i in range(5000)] + [("a", i, 1.0, False) for i in range(3)] + [(None, i, 2.0, False) for i in range(4)]
        df = spark.createDataFrame(rows, "k string, i long, a double, reset boolean").repartition(5)

        def step(state, row):  # affine maps x -> m x + b, begun anew at a reset
            m, b, flag = state or (1.0, 0.0, False)
            return (0.5, row.a, True) if row.reset else (m * 0.9, b * 0.9 + row.a, flag)

        combine = lambda s, t: t if t[2] else (s[0] * t[0], s[1] * t[0] + t[1], s[2])
        out = sequence.scan(df, "k", ["i"], step, combine, ["m", "b", "flag"], "m double, b double, flag boolean")
        parts = sequence.materialise(df.repartitionByRange(7, "k", "i").select("k", F.spark_partition_id().alias("p"))).where("k = 'hot'").select("p").distinct().count()
        assert parts >= 5
        got = {(r["k"], r["i"]): (r["m"], r["b"], r["flag"]) for r in out.collect()}
        assert len(got) == len(rows)
        for k in ("hot", "a", None):
            state = None
            for row in df.where(F.col("k").eqNullSafe(F.lit(k))).orderBy("i").collect():
                state = step(state, row)
                assert got[k, row["i"]] == pytest.approx(state)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
