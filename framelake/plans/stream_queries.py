"""Streams on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.plans.registry import query, table
from framelake.sources.scratch import scratch_dir
from framelake.streaming import steps


def frames_of(events: DataFrame) -> DataFrame:
    """events as frames: a video for each user, with a turn, a shear, a growth and a move from each frame to the one before."""
    e, f = F.col("event_id"), lambda n: (F.col("event_id") % n).cast("double")
    # divisors that give no short decimals, so that no rounded value lies half way
    h = (1 + (f(7) - 2) / 97.3, (f(11) - 4) / 61.7, (F.col("value") - 5) * 1.0137, (f(5) - 2) / 41.3, 1 + (f(3) - 1) / 53.9, (f(9) - 4) * 0.9871, (f(19) - 9) / 1.03e6, (f(23) - 11) / 1.07e6, F.lit(1.0))
    found = e % 13 >= 2
    return events.select(F.col("user_id").alias("video"), e.alias("frame_id"), F.lit(480).alias("h"), F.when(e % 101 == 0, 640).otherwise(854).alias("w"), (F.col("value") * 4).alias("blur"), *[F.when(found, c).alias(n) for c, n in zip(h, steps.NAMES)])


_NINE = [f"{i}{j}" for i in range(3) for j in range(3)]
_FRAMES = """
e AS (SELECT user_id AS video, event_id AS frame_id, CASE WHEN event_id % 101 = 0 THEN 640 ELSE 854 END AS w, value * 4 >= 30 AS sharp, event_id % 13 < 2 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
    1 + (event_id % 7 - 2) / 97.3 AS s00, (event_id % 11 - 4) / 61.7 AS s01, (value - 5) * 1.0137 AS s02, (event_id % 5 - 2) / 41.3 AS s10, 1 + (event_id % 3 - 1) / 53.9 AS s11, CAST(event_id % 9 - 4 AS DOUBLE) * 0.9871 AS s12, (event_id % 19 - 9) / 1.03e6 AS s20, (event_id % 23 - 11) / 1.07e6 AS s21, 1.0::DOUBLE AS s22 FROM events)"""


def _folded(failure: str, reorient: str) -> str:
    """SQL of the accumulated transforms: b the frame's, g what the next frame counts from."""
    one = lambda n: "1.0::DOUBLE" if n in ("00", "11", "22") else "0.0::DOUBLE"
    unity = ", ".join(f"{one(n)} AS b{n}" for n in _NINE)
    begins = "e.w <> f.w" + (" OR e.failed" if failure == "restart" else "")
    failed = {"restart": "0", "keep": "f.g{n}", "flag": "{one}"}[failure]
    multiplied = lambda n: f"f.g{n[0]}0 * e.s0{n[1]} + f.g{n[0]}1 * e.s1{n[1]} + f.g{n[0]}2 * e.s2{n[1]}"
    made = ", ".join(f"CASE WHEN {begins} THEN {one(n)} WHEN e.failed THEN {failed.format(n=n, one=one(n))} ELSE {multiplied(n)} END AS b{n}" for n in _NINE)
    turned = {"drift": "sharp AND NOT fresh AND (shear > 15 OR abs(rotation) > 15 OR scale > 2)", "always": "sharp AND NOT fresh", "never": "false"}[reorient]
    parts = """q AS (SELECT *, b00 / b22 AS a, b01 / b22 AS b, b10 / b22 AS c, b11 / b22 AS d FROM {source}),
        r AS (SELECT *, sqrt(a * a + c * c + 1e-8) AS r00, a * a + b * b + c * c + d * d AS tr, a * d - b * c AS det FROM q),
        s AS (SELECT *, (a * b + c * d) / r00 AS r01, sqrt(greatest(tr * tr - 4 * det * det, 0)) AS root FROM r),
        t AS (SELECT *, degrees(abs(atan(r01 / (sqrt(greatest(b * b + d * d - r01 * r01, 1e-8)) + 1e-8)))) AS shear, degrees(atan2(b10, b00)) AS rotation, greatest(sqrt((tr + root) / 2), 1 / sqrt(greatest((tr - root) / 2, 1e-16))) AS scale FROM s)"""
    keep = "video, frame_id, w, rn, sharp, fresh, epoch, needs, " + ", ".join(f"b{n}" for n in _NINE) + ", shear, rotation, scale"
    after = ", ".join(f"CASE WHEN {turned} THEN {one(n)} ELSE b{n} END AS g{n}" for n in _NINE)
    first = f"(SELECT video, frame_id, w, rn, sharp, true AS fresh, 0 AS epoch, false AS needs, {unity} FROM e WHERE rn = 1)"
    more = f"(SELECT e.video, e.frame_id, e.w, e.rn, e.sharp, {begins} AS fresh, f.epoch + CAST({begins} AS INTEGER) AS epoch, {'NOT (' + begins + ') AND e.failed' if failure == 'flag' else 'false'} AS needs, {made} FROM f JOIN e ON e.video = f.video AND e.rn = f.rn + 1)"
    chain = lambda source: f"SELECT {keep}, {turned} AS turned, {after} FROM (WITH {parts.format(source=source)} SELECT * FROM t)"
    return f"WITH RECURSIVE {_FRAMES.strip()}, f AS ({chain(first)} UNION ALL {chain(more)})"


_RESULT = "SELECT video, frame_id, " + ", ".join(f"round(b{n}, 6) + 0.0 AS h{n}" for n in _NINE) + ", round(shear, 5) AS shear, round(rotation, 5) + 0.0 AS rotation, round(scale, 5) AS scale, CAST(epoch AS BIGINT) AS epoch, sharp AS in_canvas, turned AS reoriented, needs AS needs_reset FROM f"


def _rounded(done: DataFrame) -> DataFrame:
    near = lambda c, n: (F.round(c, n) + 0.0).alias(c)
    return done.select("video", "frame_id", *[near(n, 6) for n in steps.NAMES], *[near(n, 5) for n in ("shear", "rotation", "scale")], "epoch", "in_canvas", "reoriented", "needs_reset")


@query(_folded("flag", "drift") + _RESULT)
def step_batch(spark: SparkSession, d: str) -> DataFrame:
    """The step's fold over all frames as a batch, in its exported form."""
    return _rounded(steps.batch_steps(frames_of(table(spark, d, "events"))))


@query(_folded("restart", "drift") + _RESULT)
def step_restarting(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(steps.batch_steps(frames_of(table(spark, d, "events")), steps.STITCHER))


@query(_folded("keep", "always") + _RESULT)
def step_tracking(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(steps.batch_steps(frames_of(table(spark, d, "events")), steps.TRACKER))


@query(_folded("restart", "never") + _RESULT)
def step_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(steps.batch_steps(frames_of(table(spark, d, "events")), steps.PREDICTIONS))


@query(_folded("flag", "drift") + """, v AS (SELECT *, b00*(b11*b22 - b12*b21) - b01*(b10*b22 - b12*b20) + b02*(b10*b21 - b11*b20) AS det, 900.0 + frame_id % 50 - 854 AS x, 500.0 + frame_id % 30 - 480 AS y FROM f),
i AS (SELECT *, ((b10*b21 - b11*b20)*x + (b01*b20 - b00*b21)*y + (b00*b11 - b01*b10)) / det AS z FROM v)
SELECT video, frame_id, round(((b11*b22 - b12*b21)*x + (b02*b21 - b01*b22)*y + (b01*b12 - b02*b11)) / det / greatest(z, 1e-8), 4) AS fx, round(((b12*b20 - b10*b22)*x + (b00*b22 - b02*b20)*y + (b02*b10 - b00*b12)) / det / greatest(z, 1e-8), 4) AS fy FROM i""")
def reproject_points(spark: SparkSession, d: str) -> DataFrame:
    """A point of each frame's canvas led back to the frame."""
    frames = frames_of(table(spark, d, "events"))
    points = frames.select("video", "frame_id", (900.0 + F.col("frame_id") % 50).alias("px"), (500.0 + F.col("frame_id") % 30).alias("py"))
    back = steps.points_in_frame(points, steps.batch_steps(frames), F.lit(854), F.lit(480))
    return back.select("video", "frame_id", F.round("fx", 4).alias("fx"), F.round("fy", 4).alias("fy"))


@query("SELECT user_id AS video, count(*) AS n, count(*) AS n_equal, CAST(0 AS BIGINT) AS n_late FROM events GROUP BY 1")
def stream_step_equals_batch(spark: SparkSession, d: str) -> DataFrame:
    """Per video: frames, and those where the stateful stream and the batch fold agree (all, for ordered input)."""
    root, own = scratch_dir(spark), spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = table(own, d, "events")
    stream = own.readStream.schema(source.schema).parquet(f"{d}/events.parque[t]")  # a pattern, since the table may be a file or a folder
    out = steps.stream_steps(frames_of(stream))
    run = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.schema(out.schema).parquet(f"{root}/out")
    values = lambda df: F.struct(*[c for c in df.columns if c not in ("video", "frame_id", "late")])
    seen = _rounded(seen).withColumn("s", values(_rounded(seen))).select("video", "frame_id", "s").join(seen.select("video", "frame_id", "late"), ["video", "frame_id"])
    batch = step_batch(spark, d)
    batch = batch.select("video", "frame_id", values(batch).alias("b"))
    return batch.join(seen, ["video", "frame_id"], "left").groupBy("video").agg(F.count("*").alias("n"), F.count_if(F.col("b") == F.col("s")).alias("n_equal"), F.count_if("late").alias("n_late"))


@query("""
WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS b, value FROM events)
SELECT event_type, CAST(epoch(b) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2
""")
def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sums, as the stream with a watermark gives them at its end."""
    e = table(spark, d, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("window.start").cast("bigint").alias("start"), "n", "total")
