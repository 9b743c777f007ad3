"""Evaluation metrics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators import metrics as m
from framelake.plans.registry import COUNTS, LINES, SUMS, labelled_lines, query, r6, table

_CLASSES = (0, 1, 2)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return m.class_counts(m.pairs(labelled_lines(spark, d), F.col("pred"), F.col("gt")), _CLASSES)


_BY = f"WITH {LINES.strip()}, {COUNTS.strip()}, by_cls AS (SELECT cls, {SUMS} FROM sides GROUP BY cls)"
_DICE = "CASE WHEN pred_sum + gt_sum > 0 THEN 2 * inter / (pred_sum + gt_sum + 1e-6) END"


@query(f"{_BY} SELECT cls, inter, pred_sum, gt_sum, round({_DICE}, 6) AS dice FROM by_cls")
def dice_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).withColumn("dice", r6(m.dice(F.col("inter"), F.col("pred_sum"), F.col("gt_sum"))))


@query(f"{_BY} SELECT round(avg({_DICE}), 6) AS mean_dice, count({_DICE}) AS n_classes FROM by_cls WHERE cls NOT IN (0)")
def dice_macro_mean(spark: SparkSession, d: str) -> DataFrame:
    per = _counts(spark, d).withColumn("dice", m.dice(F.col("inter"), F.col("pred_sum"), F.col("gt_sum")))
    return m.macro_mean(per, "dice", (0,)).select(r6(F.col("mean")).alias("mean_dice"), "n_classes")


@query(f"{_BY.replace('FROM lineitem', 'FROM lineitem WHERE l_returnflag <> ' + chr(39) + 'N' + chr(39))} SELECT cls, inter, pred_sum, gt_sum, round({_DICE}, 6) AS dice FROM by_cls")
def dice_ignored_gt(spark: SparkSession, d: str) -> DataFrame:
    pixels = labelled_lines(spark, d)
    counts = m.class_counts(m.pairs(pixels, F.col("pred"), F.col("gt"), ignore=(1,)), _CLASSES)
    return counts.withColumn("dice", r6(m.dice(F.col("inter"), F.col("pred_sum"), F.col("gt_sum"))))


@query("""
WITH sides AS (SELECT toxic AS pred, quality AS gt, toxic AS cls, 1 AS p, 0 AS g FROM labels UNION ALL SELECT toxic, quality, quality, 0, 1 FROM labels),
c AS (SELECT cls, CAST(sum(CASE WHEN p = 1 AND pred = gt THEN 1 ELSE 0 END) AS BIGINT) AS inter, CAST(sum(p) AS BIGINT) AS pred_sum, CAST(sum(g) AS BIGINT) AS gt_sum FROM sides GROUP BY cls)
SELECT cls, inter, pred_sum + gt_sum - inter AS union_sum, round(CASE WHEN pred_sum + gt_sum - inter > 0 THEN inter / (pred_sum + gt_sum - inter + 1e-6) END, 6) AS iou FROM c
""")
def iou_by_class(spark: SparkSession, d: str) -> DataFrame:
    c = m.class_counts(m.pairs(table(spark, d, "labels"), F.col("toxic"), F.col("quality")), (0, 1))
    return c.select("cls", "inter", (F.col("pred_sum") + F.col("gt_sum") - F.col("inter")).alias("union_sum"), r6(m.iou(F.col("inter"), F.col("pred_sum"), F.col("gt_sum"))).alias("iou"))


@query(f"""
WITH {LINES.strip()}, {COUNTS.strip()}, c AS (SELECT cls, CAST(least(floor(x / 10), 4) AS INTEGER) AS bin, {SUMS} FROM sides GROUP BY 1, 2)
SELECT a.cls, b.bin, coalesce(inter, 0) AS inter, coalesce(pred_sum, 0) AS pred_sum, coalesce(gt_sum, 0) AS gt_sum
FROM (SELECT unnest([0, 1, 2]) AS cls) a CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS bin) b LEFT JOIN c ON a.cls = c.cls AND b.bin = c.bin
""")
def binned_confusion_2d(spark: SparkSession, d: str) -> DataFrame:
    pixels = labelled_lines(spark, d).withColumn("bin", F.least(F.floor(F.col("x") / 10), F.lit(4)).cast("int"))
    c = m.class_counts(m.pairs(pixels, F.col("pred"), F.col("gt"), "bin"), _CLASSES, "bin")
    cells = spark.range(15).select((F.col("id") % 3).cast("int").alias("cls"), F.floor(F.col("id") / 3).cast("int").alias("bin"))
    zero = lambda n: F.coalesce(n, F.lit(0).cast("bigint")).alias(n)
    return cells.join(c, ["cls", "bin"], "left").select("cls", "bin", *[zero(n) for n in ("inter", "pred_sum", "gt_sum")])


@query(f"""
WITH {LINES.strip()}, {COUNTS.strip()}, per AS (SELECT image, cls, {SUMS} FROM sides GROUP BY 1, 2 HAVING sum(g) > 0),
b AS (SELECT cls, CASE WHEN gt_sum < 2 THEN 0 WHEN gt_sum < 4 THEN 1 ELSE 2 END AS bin, CAST(sum(inter) AS BIGINT) AS inter, CAST(sum(pred_sum) AS BIGINT) AS pred_sum, CAST(sum(gt_sum) AS BIGINT) AS gt_sum FROM per GROUP BY 1, 2)
SELECT cls, bin, inter, pred_sum, gt_sum, round({_DICE}, 6) AS dice FROM b
""")
def dice_size_bins(spark: SparkSession, d: str) -> DataFrame:
    """The engine's bounds are 1024 and 9216 pixels; an order has few lines, so 2 and 4 here."""
    b = m.size_bins(labelled_lines(spark, d), ["image"], 2, 4)
    return b.withColumn("dice", r6(m.dice(F.col("inter"), F.col("pred_sum"), F.col("gt_sum"))))


_CENTRE = "sqrt((x - 25.0) * (x - 25.0) + (y - 5.0) * (y - 5.0)) / (sqrt(25.0 * 25.0 + 5.0 * 5.0) + 1e-12)"


@query(f"""
WITH {LINES.strip()}, {COUNTS.strip()}, has AS (SELECT DISTINCT image, gt AS cls FROM lines),
c AS (SELECT CASE WHEN {_CENTRE} < 0.33 THEN 0 WHEN {_CENTRE} < 0.66 THEN 1 ELSE 2 END AS bin, cls, {SUMS} FROM sides SEMI JOIN has USING (image, cls) GROUP BY 1, 2)
SELECT cls, bin, inter, pred_sum, gt_sum, round({_DICE}, 6) AS dice FROM c
""")
def dice_distance_bins(spark: SparkSession, d: str) -> DataFrame:
    """Classes that an image's truth lacks don't count there, even where predicted."""
    far = m.centre_distance(F.col("x"), F.col("y"), 51, 11)
    c = m.counts_in_bins(labelled_lines(spark, d).withColumn("bin", m.bin_of(far, (0, 0.33, 0.66, 1.01))), ["image"], _CLASSES, 3)
    return c.select("cls", "bin", "inter", "pred_sum", "gt_sum", r6(m.dice(F.col("inter"), F.col("pred_sum"), F.col("gt_sum"))).alias("dice"))


_VIDEO = """
WITH e AS (SELECT event_type AS video, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS frame_id, user_id % 40 AS x, CAST(user_id // 40 AS BIGINT) AS y, event_id FROM events),
px AS (SELECT video, frame_id, x, y, max(event_id) % 5 AS cls FROM e GROUP BY 1, 2, 3, 4)"""


@query(_VIDEO + """, pair AS (SELECT c.video, c.frame_id, c.x, c.y, c.cls AS now, coalesce(p.cls, 0) AS was FROM px c JOIN (SELECT DISTINCT video, frame_id + 1 AS frame_id FROM px) q USING (video, frame_id)
    LEFT JOIN px p ON p.video = c.video AND p.frame_id = c.frame_id - 1 AND p.x = c.x + 1 AND p.y = c.y),
k AS (SELECT video, frame_id, k, count(*) FILTER (now = k AND was = k) AS i, count(*) FILTER (now = k OR was = k) AS u FROM pair, (SELECT unnest([1, 2, 4]) AS k) GROUP BY 1, 2, 3),
f AS (SELECT video, frame_id, avg(i / u) AS iou FROM k WHERE u > 0 GROUP BY 1, 2)
SELECT video, count(*) AS n_pairs, round(avg(iou), 6) AS consistency FROM f GROUP BY 1""")
def temporal_consistency(spark: SparkSession, d: str) -> DataFrame:
    """A video for each event type, a frame a day, users as pixels; the flow leads one pixel to the right; class 3 is ignored."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("bigint")
    e = table(spark, d, "events").select(F.col("event_type").alias("video"), day.alias("frame_id"), (F.col("user_id") % 40).alias("x"), F.floor(F.col("user_id") / 40).alias("y"), "event_id")
    px = e.groupBy("video", "frame_id", "x", "y").agg((F.max("event_id") % 5).cast("int").alias("v"))
    flow = px.select("video", "frame_id", "x", "y", F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))
    return m.temporal_consistency(px, flow, classes=(1, 2, 3, 4), ignore=(3,)).withColumn("consistency", r6(F.col("consistency")))


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events QUALIFY rn <= 5),
n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1), v AS (SELECT user_id, event_type, count(*) AS votes FROM f GROUP BY 1, 2)
SELECT v.user_id, event_type, votes, CASE WHEN votes >= (n + 1) // 2 THEN 255 ELSE 0 END AS mask FROM v JOIN n ON v.user_id = n.user_id
""")
def majority_vote_mask(spark: SparkSession, d: str) -> DataFrame:
    return m.majority_votes(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], "event_type")


_TYPES = ("click", "view", "purchase", "signup", "error")


@query("SELECT user_id, " + ", ".join(f"coalesce(bool_or(event_type = '{t}'), false) AS has_{t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def label_presence_pivot(spark: SparkSession, d: str) -> DataFrame:
    return m.presence(table(spark, d, "events"), "user_id", "event_type", _TYPES)


@query("SELECT event_type, " + ", ".join(f"CAST(sum(CASE WHEN value > {t} THEN 1 ELSE 0 END) AS BIGINT) AS over_{t}" for t in (10, 50, 90)) + ", count(*) AS n FROM events GROUP BY event_type")
def flag_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") > t).alias(f"over_{t}") for t in (10, 50, 90)], F.count("*").alias("n"))


_AWAY = """
WITH med AS (SELECT user_id, quantile_disc(value, 0.5) AS med FROM events GROUP BY 1),
a AS (SELECT e.user_id, event_id, value, med, abs(value - med) AS away FROM events e JOIN med ON e.user_id = med.user_id),
s AS (SELECT user_id, avg(away) AS mean, stddev_samp(away) AS sd, quantile_disc(away, 0.5) AS mad FROM a GROUP BY 1)
"""


@query(_AWAY + "SELECT a.event_id, round(away, 6) AS away, coalesce(away > mean + 3 * sd, false) AS motion FROM a JOIN s ON a.user_id = s.user_id")
def robust_motion_mask(spark: SparkSession, d: str) -> DataFrame:
    return m.robust_flags(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value").select("event_id", r6(F.col("away")).alias("away"), "motion")


@query(_AWAY + "SELECT a.user_id, round(max(med), 6) AS med, round(max(mad), 6) AS mad, CAST(sum(CASE WHEN value > med + 50 * (mad + 1e-6) THEN 1 ELSE 0 END) AS BIGINT) AS outliers FROM a JOIN s ON a.user_id = s.user_id GROUP BY 1")
def mad_outliers(spark: SparkSession, d: str) -> DataFrame:
    rows = m.robust_flags(table(spark, d, "events").select("event_id", "user_id", "value"), "user_id", "value")
    return rows.groupBy("user_id").agg(r6(F.max("med")).alias("med"), r6(F.max("mad")).alias("mad"), F.count_if("outlier").alias("outliers"))


@query("""
WITH q AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS least, max(value) AS most, quantile_cont(value, [0.5, 0.9, 0.95, 0.99]) AS q FROM events GROUP BY 1)
SELECT event_type, n, round(mean, 3) AS mean, round(sd, 3) AS std, least, most, round(q[1], 3) AS p50, round(q[2], 3) AS p90, round(q[3], 3) AS p95, round(q[4], 3) AS p99,
       round(coalesce(1000 / nullif(mean, 0), 0), 3) AS fps_mean, round(coalesce(1000 / nullif(q[3], 0), 0), 3) AS fps_p95 FROM q
""")
def latency_report(spark: SparkSession, d: str) -> DataFrame:
    return m.latency_summary(table(spark, d, "events"), "value", "event_type")


@query("""
WITH c AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY 1, 2), u AS (SELECT user_id, avg(m) AS m FROM c GROUP BY 1)
SELECT count(*) AS n_users, round(avg(m), 6) AS mean_of_means FROM u
""")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m")).groupBy("user_id").agg(F.avg("m").alias("m"))
    return per.agg(F.count("*").alias("n_users"), r6(F.avg("m")).alias("mean_of_means"))
