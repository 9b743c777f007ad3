"""Joins, sets and ordered sequences on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import parsing
from framelake.operators import joins, keypoints, profiling, sequence, split
from framelake.plans.registry import query, r6, table

#: Lag segments of the frame streams (video, start, end, startpoint), without overlaps in a video.
SEGMENTS = [(0, 0, 199, 2), (0, 300, 499, 290), (1, 50, 400, 60), (2, 0, 999999, 100), (3, 500, 700, 500)]
_SEG = "seg(video, start_frame, end_frame, startpoint) AS (VALUES " + ", ".join(map(str, SEGMENTS)) + ")"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 4).alias("video"), F.col("event_id").alias("frame_id"))


def _segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, "video long, start_frame long, end_frame long, startpoint long")


@query(f"""
WITH {_SEG}, f AS (SELECT user_id % 4 AS video, event_id AS frame_id FROM events),
j AS (SELECT f.video, frame_id, CAST(coalesce(greatest(0, ceil((frame_id - startpoint) / 6)), 0) AS BIGINT) AS "offset" FROM f LEFT JOIN seg ON f.video = seg.video AND frame_id BETWEEN start_frame AND end_frame)
SELECT video, frame_id, "offset", frame_id - "offset" AS actual FROM j
""")
def lag_correction_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return joins.correct_lag(_frames(spark, d), _segments(spark)).select("video", "frame_id", "offset", "actual")


@query(f"""
WITH {_SEG.replace("999999", "1500")}, x AS (SELECT video, startpoint, unnest(range(start_frame, end_frame + 1)) AS frame_id FROM seg)
SELECT CAST(video AS BIGINT) AS video, frame_id, CAST(greatest(0, ceil((frame_id - startpoint) / 6)) AS BIGINT) AS "offset" FROM x
""")
def lag_expansion(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    rows = [(v, a, min(b, 1500), s) for v, a, b, s in SEGMENTS]
    return joins.expand_lag(spark.createDataFrame(rows, "video long, start_frame long, end_frame long, startpoint long"))


@query("""
WITH f AS (SELECT source, CAST(max(quality) AS INTEGER) AS value FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT d.doc_id, coalesce(l.quality, f.value) AS value, CASE WHEN l.quality IS NOT NULL THEN 'direct' WHEN f.value IS NOT NULL THEN 'fallback' ELSE 'missing' END AS status
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN f ON d.source = f.source
""")
def two_level_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").select("doc_id", F.col("quality").alias("value"))
    by_source = docs.join(labels, "doc_id").groupBy("source").agg(F.max("value").alias("value"))
    return joins.by_priority(docs, "doc_id", labels, "source", by_source).select("doc_id", "value", "status")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_target_frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, lang, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 0)")
def anti_invalid_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_anti")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY 1")
def unknown_label_detection(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("click",), ("view",), ("purchase",)], "event_type string")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).join(F.broadcast(known), "event_type", "left_anti")


@query("SELECT user_id, event_id, value FROM events WHERE event_id % 7 = 3 AND event_type <> 'error'")
def stride_filter(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh frame from frame 3, as the sampling of a video asks for."""
    return table(spark, d, "events").where((F.pmod(F.col("event_id") - 3, F.lit(7)) == 0) & (F.col("event_type") != "error")).select("user_id", "event_id", "value")


@query("""
WITH u AS (SELECT doc_id AS id, 'document' AS kind, lang FROM documents UNION ALL SELECT item_id, 'benchmark', NULL FROM benchmark)
SELECT kind, lang, count(*) AS n FROM u GROUP BY 1, 2
""")
def union_by_name(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("kind"), "lang")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("kind", "lang").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'only_b' WHEN b.user_id IS NULL THEN 'only_a' ELSE 'both' END AS part FROM a FULL JOIN b ON a.user_id = b.user_id
""")
def mask_union_parts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    flags = e.where(F.col("event_type").isin("error", "purchase")).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("a"), F.bool_or(F.col("event_type") == "purchase").alias("b"))
    return flags.select("user_id", F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").otherwise("only_b").alias("part"))


def _descriptors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frame pairs of 100 ids: even ids the previous frame's keypoints, odd ones the current's."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("pair"), F.col("vec_id").alias("id"), F.col("embedding").alias("descriptor"))
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


_SCORES = """
WITH e AS (SELECT vec_id // 100 AS pair, vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT a.pair, a.id AS i, b.id AS j, round(list_inner_product(a.v, b.v), 6) AS score FROM e a JOIN e b ON a.pair = b.pair AND a.id % 2 = 0 AND b.id % 2 = 1)
"""


@query(_SCORES + """, r AS (SELECT *, row_number() OVER (PARTITION BY pair, i ORDER BY score DESC, j) AS ri, row_number() OVER (PARTITION BY pair, j ORDER BY score DESC, i) AS rj FROM s)
SELECT pair, i, j, score FROM r WHERE ri = 1 AND rj = 1 AND score > 0.1""")
def mutual_nn_match(spark: SparkSession, d: str) -> DataFrame:
    return joins.matches(*_descriptors(spark, d), "pair", 0.1)


@query(_SCORES.replace("round(list_inner_product(a.v, b.v), 6)", "list_inner_product(a.v, b.v) / 8") + """, z AS (SELECT *, 0.01 * (i % 50) AS z0, 0.02 * (j % 50) AS z1 FROM s),
l AS (SELECT pair, i, j, 2 * score - ln(sum(exp(score)) OVER (PARTITION BY pair, i)) - ln(sum(exp(score)) OVER (PARTITION BY pair, j)) - ln(1 + exp(-z0)) - ln(1 + exp(-z1)) AS log_p FROM z),
bin AS (SELECT pair, id AS i, -ln(1 + exp(0.01 * (id % 50))) AS none FROM e WHERE id % 2 = 0)
SELECT l.pair, l.i, round(max(log_p), 6) AS best, round(sum(exp(log_p)), 6) AS mass, round(any_value(none), 6) AS unmatched FROM l JOIN bin ON bin.pair = l.pair AND bin.i = l.i GROUP BY 1, 2""")
def double_softmax_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Of each previous keypoint the best assignment, their mass, and the log-probability of having none."""
    prev, curr = _descriptors(spark, d)
    gate = lambda side, by: side.withColumn("z", by * (F.col("id") % 50))
    rows = keypoints.best_assignments(gate(prev, 0.01), gate(curr, 0.02), "pair")
    return rows.select("pair", "i", *[r6(F.col(c)).alias(c) for c in ("best", "mass", "unmatched")])


@query("SELECT user_id, event_id, value, CAST(row_number() OVER w AS INTEGER) AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 3")
def topk_keypoints(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.top_k(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", 3, F.desc("value"), F.col("event_id"))


@query("""
WITH t AS (SELECT event_type, event_id, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events WHERE value > 20)
SELECT event_type, event_id, value FROM t WHERE n <= 50 OR rn <= 50
""")
def topk_conditional(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.top_k(table(spark, d, "events").where("value > 20").select("event_type", "event_id", "value"), "event_type", 50, F.desc("value"), F.col("event_id")).drop("rank")


@query("""
WITH t AS (SELECT user_id, event_id, value, max(value) OVER w AS most, avg(value) OVER w AS mean FROM events WINDOW w AS (PARTITION BY user_id))
SELECT user_id, event_id, value FROM t WHERE value > CASE WHEN most > 60 THEN 60 ELSE mean END
""")
def threshold_mean_fallback(spark: SparkSession, d: str) -> DataFrame:
    return keypoints.threshold_or_mean(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "value", 60.0)


def _micros(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("""
WITH e AS (SELECT *, epoch_us(ts) AS us, CAST(value * 1000 AS BIGINT) AS dur FROM events),
f AS (SELECT *, CASE WHEN us - lag(us + dur) OVER w > 3600000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, CAST(sum(dur) AS BIGINT) AS busy, CAST(max(us + dur) - min(us) AS BIGINT) AS wall FROM g GROUP BY 1, 2
""")
def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = _micros(spark, d).withColumn("dur", F.round(F.col("value") * 1000).cast("bigint"))
    out = sequence.islands(rows, "user_id", ["us", "event_id"], F.col("us"), F.col("us") + F.col("dur"), 3_600_000_000)
    return out.groupBy("user_id", F.col("island").cast("bigint").alias("island")).agg(F.count("*").alias("n"), F.sum("dur").alias("busy"), (F.max(F.col("us") + F.col("dur")) - F.min("us")).alias("wall"))


@query("""
WITH o AS (SELECT user_id, min(CASE WHEN value < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS open FROM events)
SELECT user_id, CAST(sum(open) AS BIGINT) AS run FROM o GROUP BY 1
""")
def consecutive_run_length(spark: SparkSession, d: str) -> DataFrame:
    return sequence.run_length(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 20)


@query("""
SELECT event_id, round(sum(value - 5) OVER w, 6) AS px, round(sum(event_id % 7 - 3) OVER w, 6) AS py FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def prefix_translation(spark: SparkSession, d: str) -> DataFrame:
    w = sequence._upto("user_id", ["ts", "event_id"])
    return table(spark, d, "events").select("event_id", r6(F.sum(F.col("value") - 5).over(w)).alias("px"), r6(F.sum((F.col("event_id") % 7 - 3).cast("double")).over(w)).alias("py"))


@query("""
SELECT event_id, round(exp(sum(ln(1 + (event_id % 5) / 100)) OVER w), 6) AS scale FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def prefix_scale_product(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", (1 + (F.col("event_id") % 5) / 100).alias("s"))
    return sequence.running_product(rows, "user_id", ["ts", "event_id"], F.col("s"), "scale").select("event_id", r6(F.col("scale")).alias("scale"))


_STEPS = """
WITH RECURSIVE e AS (SELECT user_id, event_id, ((event_id % 11) - 5) / 50 AS a, value / 10 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
"""


@query(_STEPS + """, f AS (
    SELECT user_id, event_id, rn, 1 AS c, a AS s, t AS x, 0.0::DOUBLE AS y FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.event_id, e.rn, f.c - f.s * e.a, f.c * e.a + f.s, f.c * e.t + f.x, f.s * e.t + f.y FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1
) SELECT event_id, round(c, 6) + 0.0 AS c, round(s, 6) + 0.0 AS s, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM f""".replace("1 AS c", "1.0::DOUBLE AS c").replace("f.c - f.s * e.a, f.c * e.a + f.s", "f.c - f.s * e.a, f.s + f.c * e.a"))
def prefix_matrix_product(spark: SparkSession, d: str) -> DataFrame:
    """Accumulated transforms H <- H S with S = [[1, -a, t], [a, 1, 0], [0, 0, 1]], by stretches of each user's events."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (((F.col("event_id") % 11) - 5) / 50).alias("a"), (F.col("value") / 10).alias("t"))

    def combine(h, s):
        return (h[0] * s[0] - h[1] * s[1], h[1] * s[0] + h[0] * s[1], h[0] * s[2] - h[1] * s[3] + h[2], h[1] * s[2] + h[0] * s[3] + h[3])

    out = sequence.scan(rows, "user_id", ["us", "event_id"], lambda h, r: combine(h or (1.0, 0.0, 0.0, 0.0), (1.0, r.a, r.t, 0.0)), combine, ["c", "s", "x", "y"], "c double, s double, x double, y double")
    return out.select("event_id", *[(r6(F.col(n)) + 0.0).alias(n) for n in ("c", "s", "x", "y")])


_BOX = "CAST(floor(value) AS BIGINT) AS x1, event_id % 40 AS y1, CAST(floor(value) AS BIGINT) + 60 + event_id % 30 AS x2, event_id % 40 + 50 + event_id % 17 AS y2"


def _clamped(n: str) -> str:
    return f"CAST(round_even(0.3::DOUBLE * least(greatest(e.{n}, f.{n} - 20), f.{n} + 20) + 0.7::DOUBLE * f.{n}, 0) AS BIGINT)"


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, {_BOX}, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (
    SELECT user_id, event_id, rn, x1, y1, x2, y2 FROM e WHERE rn = 1
    UNION ALL
    SELECT user_id, event_id, rn, CASE WHEN ok THEN nx1 ELSE x1 END, CASE WHEN ok THEN ny1 ELSE y1 END, CASE WHEN ok THEN nx2 ELSE x2 END, CASE WHEN ok THEN ny2 ELSE y2 END
    FROM (
        SELECT *, (nx2 - nx1) > 0 AND (ny2 - ny1) > 0 AND (nx2 - nx1) * (ny2 - ny1) >= 0.6 * (x2 - x1) * (y2 - y1) AS ok
        FROM (SELECT e.user_id, e.event_id, e.rn, f.x1, f.y1, f.x2, f.y2, {_clamped("x1")} AS nx1, {_clamped("y1")} AS ny1, {_clamped("x2")} AS nx2, {_clamped("y2")} AS ny2
              FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
    )
) SELECT event_id, x1 AS sx1, y1 AS sy1, x2 AS sx2, y2 AS sy2 FROM f
""")
def bbox_ema_fold(spark: SparkSession, d: str) -> DataFrame:
    low, e = F.floor("value").cast("bigint"), F.col("event_id")
    rows = table(spark, d, "events").select("event_id", "user_id", low.alias("x1"), (e % 40).alias("y1"), (low + 60 + e % 30).alias("x2"), (e % 40 + 50 + e % 17).alias("y2"))

    def step(last, r):
        box = sequence.smooth_box(last, (int(r.x1), int(r.y1), int(r.x2), int(r.y2)))
        return box, box

    return sequence.fold(rows, "user_id", ["event_id"], step, ["sx1", "sy1", "sx2", "sy2"], "sx1 long, sy1 long, sx2 long, sy2 long").select("event_id", "sx1", "sy1", "sx2", "sy2")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch FROM events")
def state_epochs(spark: SparkSession, d: str) -> DataFrame:
    return sequence.epochs(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", F.col("epoch").cast("bigint").alias("epoch"))


@query("SELECT event_id, last_value(CASE WHEN value >= 5 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS base FROM events")
def blur_gate_carry(spark: SparkSession, d: str) -> DataFrame:
    return sequence.carry(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_id"), F.col("value") >= 5, "base").select("event_id", "base")


@query("""
SELECT event_id, max(value) OVER w AS best, coalesce(value > max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return sequence.best_so_far(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "best", "improved")


@query("""
WITH c AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_frame FROM conversations)
SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN prev_frame = turn - 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_continuous FROM c GROUP BY 1
""")
def continuity_join(spark: SparkSession, d: str) -> DataFrame:
    rows = joins.consecutive(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if("continuous").alias("n_continuous"))


@query("""
SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events) WHERE place = 1
""")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return profiling.running_rank(table(spark, d, "events"), "event_type", F.col("ts"), F.col("event_id")).where("place = 1").select("event_type", "event_id")


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


@query("""
WITH t AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS op, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1)
SELECT op, total, n, round(100 * total / sum(total) OVER (), 6) AS pct FROM t ORDER BY total DESC, op LIMIT 30
""")
def profile_topn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(_k(F.col("props")).alias("op"), F.round(F.col("value") * 1000).cast("bigint").alias("dur"))
    return profiling.totals(rows, "op", "dur", 30).select("op", "total", "n", r6(F.col("pct")).alias("pct"))


@query("""
WITH s AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS node, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS kind, CAST(round(value * 1000) AS BIGINT) AS dur FROM events),
t AS (SELECT node, CAST(sum(CASE WHEN kind = 1 THEN dur ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE WHEN kind = 2 THEN dur ELSE 0 END) AS BIGINT) AS kernel, CAST(sum(CASE WHEN kind = 3 THEN dur ELSE 0 END) AS BIGINT) AS after FROM s GROUP BY 1)
SELECT node, before, kernel, after, round(coalesce(100 * (before + after) / nullif(before + kernel + after, 0), 0), 6) AS overhead FROM t
""")
def profile_fence_overhead(spark: SparkSession, d: str) -> DataFrame:
    is_ = lambda t: F.col("event_type") == t
    name = F.when(is_("view"), "n" + profiling.BEFORE).when(is_("click"), "n" + profiling.KERNEL).when(is_("purchase"), "n" + profiling.AFTER).otherwise("n")
    rows = table(spark, d, "events").select(_k(F.col("props")).alias("node"), profiling.event_kind(F.lit("Node"), name).alias("kind"), F.round(F.col("value") * 1000).cast("bigint").alias("dur"))
    return profiling.fence_overhead(rows, "node", "kind", "dur").withColumn("overhead", r6(F.col("overhead")))


@query("""
SELECT page_id, nullif(regexp_extract(url, '//([a-z.]+)/', 1), '') AS host, split_part(url, '/', 4) AS section,
       try_cast(nullif(regexp_extract(url, '/([0-9]+)([?#]|$)', 1), '') AS BIGINT) AS frame_id, CASE WHEN regexp_matches(split_part(url, '/', 4), '^[a-z]{2}$') THEN split_part(url, '/', 4) ELSE 'unknown' END AS lang
FROM pages
""")
def parse_paths(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    section = F.split_part(url, F.lit("/"), F.lit(4))
    return table(spark, d, "pages").select(
        "page_id", F.nullif(F.regexp_extract(url, r"//([a-z.]+)/", 1), F.lit("")).alias("host"), section.alias("section"),
        F.regexp_extract(url, r"/([0-9]+)([?#]|$)", 1).try_cast("bigint").alias("frame_id"), F.when(section.rlike("^[a-z]{2}$"), section).otherwise("unknown").alias("lang"),
    )


@query("""
SELECT event_id, CASE WHEN us >= 1000000 THEN printf('%.2f s', us / 1e6) WHEN us >= 1000 THEN printf('%.2f ms', us / 1e3) ELSE printf('%.1f us', us) END AS took,
       CASE CAST(k AS INTEGER) WHEN 0 THEN 0 WHEN 5 THEN 1 WHEN 11 THEN 2 WHEN 12 THEN 3 WHEN 13 THEN 4 WHEN 21 THEN 5 WHEN 22 THEN 6 WHEN 23 THEN 7 WHEN 24 THEN 8 WHEN 25 THEN 9 WHEN 31 THEN 10 WHEN 32 THEN 11 WHEN 33 THEN 12 ELSE 0 END AS cls
FROM (SELECT event_id, event_id * event_id + 0.3::DOUBLE AS us, json_extract(props, '$.k') AS k FROM events)
""")
def readable_units_and_lut(spark: SparkSession, d: str) -> DataFrame:
    us = F.col("event_id") * F.col("event_id") + 0.3
    return table(spark, d, "events").select("event_id", parsing.duration_text(us).alias("took"), parsing.raw_to_class(_k(F.col("props"))).alias("cls"))


@query("""
WITH g AS (SELECT source, max(CASE WHEN lang = 'de' THEN 2 WHEN lang = 'fr' THEN 1 ELSE 0 END) AS stratum, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY n DESC, source) - 1 AS p FROM g)
SELECT source, stratum, n, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold FROM r
""")
def group_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    stratum = F.when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 1).otherwise(0)
    return split.group_folds(table(spark, d, "documents").select("source", "lang"), "source", stratum)
