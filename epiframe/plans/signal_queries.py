"""Queries over frames and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe import proxy
from epiframe.functions import control, kernels
from epiframe.operators import intervals as I
from epiframe.operators import signals as S
from epiframe.operators.datasets import anchor_topics
from epiframe.plans.registry import query
from epiframe.proxy import FPS, with_views
from epiframe.sources.log_episodes import gap_episodes, in_windows

GAP_US = 6 * 3600 * 1_000_000


def r6(*columns: str):
    return [F.round(F.col(c), 6).alias(c) for c in columns]


@query(with_views(f"""s AS (SELECT *, row_number() OVER w - 1 AS position, CASE WHEN t_us - lag(t_us) OVER w > {GAP_US} THEN 1 ELSE 0 END AS o FROM messages WINDOW w AS (PARTITION BY stream ORDER BY t_us, id)),
g AS (SELECT *, sum(o) OVER (PARTITION BY stream ORDER BY t_us, id) AS segment FROM s)
SELECT stream, CAST(segment AS BIGINT) AS segment, min(position) AS first_index, max(position) AS last_index, count(*) AS length, max(t_us) - min(t_us) AS span FROM g GROUP BY stream, segment""", "messages"))
def gap_split(spark: SparkSession, d: str) -> DataFrame:
    return S.segments(S.gap_split(proxy.messages(spark, d), "stream", "t_us", "id", GAP_US), "stream", "t_us")


@query(with_views("SELECT episode_index, frame_index, row_number() OVER (ORDER BY episode_index, frame_index) - 1 AS index FROM frames", "frames"))
def frame_renumber(spark: SparkSession, d: str) -> DataFrame:
    return S.global_index(proxy.frames(spark, d)).select("episode_index", "frame_index", "index")


_DERIVED = """v AS (SELECT *, (value - lag(value) OVER (PARTITION BY episode_index ORDER BY frame_index)) * 10.0 AS velocity FROM frames),
a AS (SELECT *, (velocity - lag(velocity) OVER (PARTITION BY episode_index ORDER BY frame_index)) * 10.0 AS acceleration FROM v),
j AS (SELECT *, (acceleration - lag(acceleration) OVER (PARTITION BY episode_index ORDER BY frame_index)) * 10.0 AS jerk FROM a)"""


@query(with_views(_DERIVED + "\nSELECT episode_index, frame_index, round(velocity, 6) AS velocity, round(acceleration, 6) AS acceleration, round(jerk, 6) AS jerk FROM j", "frames"))
def velocity_accel_jerk(spark: SparkSession, d: str) -> DataFrame:
    return S.derivatives(proxy.frames(spark, d), FPS).select("episode_index", "frame_index", *r6("velocity", "acceleration", "jerk"))


_Z = """m AS (SELECT episode_index, quantile_cont(value, 0.5) AS med FROM frames GROUP BY 1),
dv AS (SELECT f.*, med, abs(value - med) AS dev FROM frames f JOIN m USING (episode_index)),
sc AS (SELECT episode_index, 1.4826 * quantile_cont(dev, 0.5) AS mad, quantile_cont(dev, 0.75) AS fb FROM dv GROUP BY 1)"""


@query(with_views(_Z + "\nSELECT episode_index, frame_index, round((value - med) / CASE WHEN mad > 1e-9 THEN mad ELSE greatest(fb, 1e-6) END, 6) AS z FROM dv JOIN sc USING (episode_index)", "frames"))
def robust_zscore(spark: SparkSession, d: str) -> DataFrame:
    return S.robust_z(proxy.frames(spark, d), "value").select("episode_index", "frame_index", *r6("z"))


_RANGE = "r AS (SELECT episode_index, quantile_cont(value, 0.01) AS low, quantile_cont(value, 0.99) AS high FROM frames GROUP BY 1)"


@query(with_views(_RANGE + "\nSELECT episode_index, round(low, 6) AS low, round(high, 6) AS high, round(greatest(0.0, high - low), 6) AS range, greatest(0.0, high - low) >= 0.001 AS active FROM r", "frames"))
def quantile_range(spark: SparkSession, d: str) -> DataFrame:
    return S.signal_range(proxy.frames(spark, d), "value").select("episode_index", *r6("low", "high", "range"), "active")


@query(with_views("""l AS (SELECT episode_index, UNNEST([{'dim': 'value', 'x': value}, {'dim': 'k', 'x': k}]) AS u FROM frames),
q AS (SELECT episode_index, u.dim AS dim, quantile_cont(u.x, 0.99) - quantile_cont(u.x, 0.01) AS span FROM l GROUP BY 1, 2)
SELECT episode_index, dim FROM q WHERE greatest(0.0, span) >= 0.001""", "frames"))
def active_dims(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.frames(spark, d)
    long = f.select("episode_index", F.explode(F.array(F.struct(F.lit("value").alias("dim"), F.col("value").alias("x")), F.struct(F.lit("k").alias("dim"), F.col("k").alias("x")))).alias("u")).select(F.struct("episode_index", "u.dim").alias("key"), "u.x")
    return S.signal_range(long, "x", "key").where("active").select("key.episode_index", "key.dim")


_RUNS = """t AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM frames WHERE value > 50),
runs AS (SELECT episode_index, min(frame_index) AS a, max(frame_index) + 1 AS b FROM t GROUP BY episode_index, g HAVING count(*) >= 2),
o AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY episode_index ORDER BY a) > 2 THEN 1 ELSE 0 END AS o FROM runs),
mg AS (SELECT *, sum(o) OVER (PARTITION BY episode_index ORDER BY a) AS m FROM o),
n AS (SELECT episode_index, count(*) / 10.0 AS duration FROM frames GROUP BY 1)
SELECT episode_index, round(greatest(0.0, min(a) / 10.0 - 0.1), 6) AS start_s, round(least(min(duration), max(b) / 10.0 + 0.1), 6) AS end_s FROM mg JOIN n USING (episode_index) GROUP BY episode_index, m"""


@query(with_views(_RUNS, "frames"))
def mask_to_intervals(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.frames(spark, d).withColumn("mask", F.col("value") > 50)
    return I.mask_to_intervals(f, "mask", FPS, minimum=0.2, merge_gap=0.2, context=0.1).select("episode_index", *r6("start_s", "end_s"))


@query(with_views("""t AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY episode_index ORDER BY frame_index)) <= 20 AS still FROM frames),
s AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM t WHERE still)
SELECT episode_index, round(min(frame_index) / 10.0, 6) AS start_s, round((max(frame_index) + 1) / 10.0, 6) AS end_s FROM s GROUP BY episode_index, g HAVING count(*) >= 3""", "frames"))
def stationary_runs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("episode_index").orderBy("frame_index")
    f = proxy.frames(spark, d).withColumn("still", F.coalesce(F.abs(F.col("value") - F.lag("value").over(w)) <= 20, F.lit(False)))
    return I.mask_to_intervals(f, "still", FPS, minimum=0.3).select("episode_index", *r6("start_s", "end_s"))


@query(with_views("SELECT episode_index, greatest(max(value) - min(value), max(k) - min(k)) < 99.5 AS near_zero, round(max(value) - min(value), 6) AS motion FROM frames GROUP BY 1", "frames"))
def near_zero_episode(spark: SparkSession, d: str) -> DataFrame:
    span = lambda c: F.max(c) - F.min(c)
    return proxy.frames(spark, d).groupBy("episode_index").agg((F.greatest(span("value"), span("k")) < 99.5).alias("near_zero"), F.round(span("value"), 6).alias("motion"))


_STEPS = "st AS (SELECT * FROM (SELECT *, value - lag(value) OVER (PARTITION BY episode_index ORDER BY frame_index) AS step FROM frames) WHERE abs(step) >= 30)"


@query(with_views(_STEPS + """, n AS (SELECT episode_index, count(*) / 10.0 AS duration FROM frames GROUP BY 1)
SELECT episode_index, count(step) AS transitions, round(count(step) / max(duration), 6) AS rate FROM n LEFT JOIN st USING (episode_index) GROUP BY 1""", "frames"))
def transition_rate(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.frames(spark, d)
    t = S.transitions(f, 30.0).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    n = f.groupBy("episode_index").agg((F.count(F.lit(1)) / FPS).alias("duration"))
    return n.join(t, "episode_index", "left").select("episode_index", F.coalesce("n", F.lit(0)).cast("long").alias("transitions"), F.round(F.coalesce("n", F.lit(0)) / F.col("duration"), 6).alias("rate"))


@query(with_views(_STEPS + """, w AS (SELECT episode_index, frame_index AS f1, lead(frame_index, 1) OVER o AS f2, lead(frame_index, 2) OVER o AS f3, step AS s1, lead(step, 1) OVER o AS s2, lead(step, 2) OVER o AS s3 FROM st WINDOW o AS (PARTITION BY episode_index ORDER BY frame_index))
SELECT episode_index, f1, f2, f3 FROM w WHERE f3 - f1 <= 6 AND sign(s1) = sign(s3) AND sign(s1) <> sign(s2) QUALIFY row_number() OVER (PARTITION BY episode_index ORDER BY f1) = 1""", "frames"))
def alternating_triples(spark: SparkSession, d: str) -> DataFrame:
    return S.regrasps(proxy.frames(spark, d), 30.0, 6)


_HITS = _DERIVED + """,
am AS (SELECT episode_index, quantile_cont(acceleration, 0.5) AS md FROM j WHERE acceleration IS NOT NULL GROUP BY 1),
ad AS (SELECT episode_index, quantile_cont(abs(acceleration - md), 0.5) * 1.4826 AS mad, quantile_cont(abs(acceleration - md), 0.75) AS fb, any_value(md) AS md FROM j JOIN am USING (episode_index) WHERE acceleration IS NOT NULL GROUP BY 1),
jm AS (SELECT episode_index, quantile_cont(jerk, 0.5) AS md FROM j WHERE jerk IS NOT NULL GROUP BY 1),
jd AS (SELECT episode_index, quantile_cont(abs(jerk - md), 0.5) * 1.4826 AS mad, quantile_cont(abs(jerk - md), 0.75) AS fb, any_value(md) AS md FROM j JOIN jm USING (episode_index) WHERE jerk IS NOT NULL GROUP BY 1),
""" + _RANGE + """,
h AS (SELECT j.episode_index, frame_index, value,
  coalesce(abs((acceleration - ad.md) / CASE WHEN ad.mad > 1e-9 THEN ad.mad ELSE greatest(ad.fb, 1e-6) END) > 2 AND abs(acceleration) / (greatest(high - low, 2.220446049250313e-16) * 100.0) > 0.15 AND high - low >= 0.001, false) AS a_hit,
  coalesce(abs((jerk - jd.md) / CASE WHEN jd.mad > 1e-9 THEN jd.mad ELSE greatest(jd.fb, 1e-6) END) > 2 AND abs(jerk) / (greatest(high - low, 2.220446049250313e-16) * 1000.0) > 0.3 AND high - low >= 0.001, false) AS j_hit
  FROM j LEFT JOIN ad USING (episode_index) LEFT JOIN jd ON jd.episode_index = j.episode_index JOIN r ON r.episode_index = j.episode_index),
hh AS (SELECT *, a_hit AND max(j_hit) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hit FROM h)"""


@query(with_views(_HITS + "\nSELECT episode_index, frame_index FROM hh WHERE hit", "frames"))
def derivative_align(spark: SparkSession, d: str) -> DataFrame:
    return S.jitter_hits(proxy.frames(spark, d), FPS, accel_z=2, jerk_z=2).where("hit").select("episode_index", "frame_index")


_LOCAL = """w AS (SELECT episode_index, frame_index, list(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM frames),
s AS (SELECT *, list_transform(range(2, len(w) + 1), lambda i: w[i] - w[i - 1]) AS st, list_max(w) - list_min(w) AS span FROM w WHERE len(w) >= 3),
g AS (SELECT *, list_transform(list_filter(st, lambda x: abs(x) >= greatest(2.220446049250313e-16, 0.00005, span * 0.01)), lambda x: sign(x)) AS sg FROM s)"""


@query(with_views(_LOCAL + """
SELECT episode_index, frame_index, CAST(len(list_filter(range(2, len(sg) + 1), lambda i: sg[i] <> sg[i - 1])) AS INTEGER) AS reversals,
round(greatest(0.0, list_sum(list_transform(st, lambda x: abs(x))) - abs(w[-1] - w[1])) / greatest(span, 2.220446049250313e-16), 6) AS excess FROM g""", "frames"))
def local_window_excess(spark: SparkSession, d: str) -> DataFrame:
    return S.local_motion(proxy.frames(spark, d), 2).where("excess is not null").select("episode_index", "frame_index", "reversals", *r6("excess"))


@query(with_views("""x AS (SELECT episode_index, frame_index, CASE WHEN id % 97 = 0 THEN CAST('nan' AS DOUBLE) WHEN id % 89 = 0 THEN CAST('inf' AS DOUBLE) ELSE value END AS v FROM frames)
SELECT episode_index, count(*) AS frames, count(*) FILTER (NOT isfinite(v)) AS bad_values, min(frame_index) FILTER (NOT isfinite(v)) / 10.0 AS start_s,
least(count(*) / 10.0, (max(frame_index) FILTER (NOT isfinite(v)) + 1) / 10.0) AS end_s FROM x GROUP BY 1 HAVING count(*) FILTER (NOT isfinite(v)) > 0""", "frames"))
def signal_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Spans from the first to the last frame that is not finite."""
    v = F.when(F.col("id") % 97 == 0, float("nan")).when(F.col("id") % 89 == 0, float("inf")).otherwise(F.col("value"))
    f = proxy.frames(spark, d).withColumn("v", v).withColumn("bad", F.isnan("v") | (F.abs("v") == float("inf")))
    at = lambda g: g(F.when(F.col("bad"), F.col("frame_index")))
    out = f.groupBy("episode_index").agg(F.count(F.lit(1)).alias("frames"), F.count_if("bad").alias("bad_values"), (at(F.min) / FPS).alias("start_s"), F.least(F.count(F.lit(1)) / FPS, (at(F.max) + 1) / FPS).alias("end_s"))
    return out.where("bad_values > 0")


@query(with_views("""n AS (SELECT episode_index, count(*) AS n, count(*) FILTER (topic IN ('click', 'view')) AS action_n, count(*) FILTER (k < 90) AS state_n FROM frames GROUP BY 1)
SELECT episode_index, n, action_n, state_n, abs(action_n - n) > greatest(2, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS action_mismatch,
greatest(action_n, state_n) - least(action_n, state_n) > greatest(2, CAST(round_even(greatest(action_n, state_n) * 0.1, 0) AS BIGINT)) AS pair_mismatch FROM n""", "frames"))
def length_mismatch(spark: SparkSession, d: str) -> DataFrame:
    n = proxy.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("topic").isin("click", "view")).alias("action_n"), F.count_if(F.col("k") < 90).alias("state_n"))
    limit = lambda c: F.greatest(F.lit(2).cast("long"), F.rint(c * 0.1).cast("long"))
    most, least = F.greatest("action_n", "state_n"), F.least("action_n", "state_n")
    return n.select("*", (F.abs(F.col("action_n") - F.col("n")) > limit(F.col("n"))).alias("action_mismatch"), (most - least > limit(most)).alias("pair_mismatch"))


@query(with_views("""n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames)
SELECT episode_index, frame_index, value FROM n WHERE n <= 12 OR frame_index IN (SELECT unnest(list_transform(range(0, 12), lambda i: CAST(round_even(i * ((n - 1) / 11.0), 0) AS BIGINT))))""", "frames"))
def linspace_downsample(spark: SparkSession, d: str) -> DataFrame:
    return S.downsample(proxy.frames(spark, d), ["episode_index"], "frame_index", 12).select("episode_index", "frame_index", "value")


@query(with_views("""n AS (SELECT *, count(*) OVER (PARTITION BY episode_index) AS n FROM frames)
SELECT episode_index, frame_index, value FROM n WHERE n <= 12 OR frame_index IN (SELECT unnest(list_transform(range(0, 12), lambda i: CAST(floor(i * n / 12.0) AS BIGINT))))""", "frames"))
def stride_downsample(spark: SparkSession, d: str) -> DataFrame:
    return S.downsample(proxy.frames(spark, d), ["episode_index"], "frame_index", 12, even=False).select("episode_index", "frame_index", "value")


@query(with_views("""n AS (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1),
t AS (SELECT episode_index, unnest(list_transform(range(0, 20), lambda i: {'target': i, 'src': CAST(round_even(i * (n - 1) / 19.0, 0) AS BIGINT)})) AS x FROM n)
SELECT t.episode_index, x.target AS target, x.src AS frame_index, value FROM t JOIN frames f ON f.episode_index = t.episode_index AND f.frame_index = x.src""", "frames"))
def nearest_align(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_rank(proxy.frames(spark, d), ["episode_index"], "frame_index", 20).select("episode_index", "target", "frame_index", "value")


@query(with_views("""a AS (SELECT episode_index, value, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS position FROM frames WHERE topic = 'click'),
b AS (SELECT episode_index, value, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) - 1 AS position FROM frames WHERE topic = 'view')
SELECT a.episode_index, a.position, a.value AS left_value, b.value AS right_value FROM a JOIN b USING (episode_index, position)""", "frames"))
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.frames(spark, d).select("episode_index", "frame_index", "value", "topic")
    z = S.positional_zip(f.where("topic = 'click'"), f.where("topic = 'view'"), ["episode_index"], "frame_index")
    return z.select("episode_index", "position", F.col("value").alias("left_value"), F.col("value_r").alias("right_value"))


@query(with_views("SELECT topic, count(*) AS n, round((count(*) - 1) / ((max(t_us) - min(t_us)) / 1000000.0), 9) AS hz FROM messages GROUP BY 1", "messages"))
def topic_rate(spark: SparkSession, d: str) -> DataFrame:
    span = (F.max("t_us") - F.min("t_us")) / 1000000.0
    return proxy.messages(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.round((F.count(F.lit(1)) - 1) / span, 9).alias("hz"))


@query(with_views("SELECT stream, topic AS anchor FROM (SELECT stream, topic, count(*) AS n FROM messages GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY stream ORDER BY n DESC, topic) = 1", "messages"))
def anchor_topic(spark: SparkSession, d: str) -> DataFrame:
    """The densest topic of each stream, by which it is split."""
    n = proxy.messages(spark, d).groupBy("stream", "topic").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("stream").agg(F.min(F.struct((-F.col("n")).alias("n"), "topic")).alias("x"))
    return best.select("stream", F.col("x.topic").alias("anchor"))


@query(with_views("SELECT stream, topic, value, t_us FROM messages QUALIFY row_number() OVER (PARTITION BY stream, topic ORDER BY t_us DESC, id DESC, value DESC) = 1", "messages"))
def latest_value(spark: SparkSession, d: str) -> DataFrame:
    last = F.max(F.struct("t_us", "id", "value"))
    return proxy.messages(spark, d).groupBy("stream", "topic").agg(last.alias("x")).select("stream", "topic", "x.value", "x.t_us")


@query(with_views("""l AS (SELECT stream, topic, max(t_us) AS t FROM messages GROUP BY 1, 2), n AS (SELECT max(t_us) AS now FROM messages)
SELECT stream, count(*) AS keys, count(*) FILTER (now - t <= 172800000000) AS fresh, count(*) = count(*) FILTER (now - t <= 172800000000) AS accepted FROM l, n GROUP BY 1""", "messages"))
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """A stream is accepted if none of its keys is older than two days at the newest message of all."""
    m = proxy.messages(spark, d)
    last = m.groupBy("stream", "topic").agg(F.max("t_us").alias("t")).join(F.broadcast(m.agg(F.max("t_us").alias("now"))))  # one row
    fresh = F.count_if(F.col("now") - F.col("t") <= 172800000000)
    return last.groupBy("stream").agg(F.count(F.lit(1)).alias("keys"), fresh.alias("fresh"), (F.count(F.lit(1)) == fresh).alias("accepted"))


@query(with_views("m2 AS (SELECT *, max(t_us) OVER (PARTITION BY stream) AS last FROM messages) SELECT stream, id, value FROM m2 WHERE last - t_us <= 86400000000", "messages"))
def trailing_window(spark: SparkSession, d: str) -> DataFrame:
    return kernels.trailing(proxy.messages(spark, d), ["stream"], "t_us", 86400000000).select("stream", "id", "value")


@query(with_views("""i AS (SELECT *, row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS i FROM frames), f AS (SELECT *, i - row_number() OVER (PARTITION BY episode_index ORDER BY frame_index) AS g FROM i WHERE value > 20)
SELECT episode_index, min(frame_index) AS first, count(*) AS length FROM f GROUP BY episode_index, g HAVING count(*) >= 3""", "frames"))
def failure_streak(spark: SparkSession, d: str) -> DataFrame:
    return control.failure_streaks(proxy.frames(spark, d), ["episode_index"], "frame_index", "value > 20", 3)


@query(with_views("""c AS (SELECT *, greatest(1.0, least(60.0, value)) AS clamped FROM frames), b AS (SELECT *, lag(clamped) OVER (PARTITION BY episode_index ORDER BY frame_index) AS before FROM c),
v AS (SELECT *, CASE WHEN value < 0.9 OR value > 60.1 THEN 'limit' WHEN abs(clamped - before) > 40.1 THEN 'step' END AS kind FROM b)
SELECT episode_index, frame_index, kind FROM v WHERE kind IS NOT NULL""", "frames"))
def step_limit_check(spark: SparkSession, d: str) -> DataFrame:
    return control.limit_violations(proxy.frames(spark, d), ["episode_index"], "frame_index", "value", 1.0, 60.0, 40.0, 0.1).select("episode_index", "frame_index", "kind")


@query(with_views("SELECT episode_index, count(*) FILTER (value > 60) AS held, count(*) FILTER (value <= 60 AND value < 1) AS errors, count(*) FILTER (value BETWEEN 1 AND 60) AS accepted FROM frames GROUP BY 1", "frames"))
def safety_rejection_count(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("value") > 60, "safety").when(F.col("value") < 1, "malformed")
    return kernels.rejections(proxy.frames(spark, d).withColumn("reject_kind", kind), ["episode_index"])


@query(with_views("SELECT episode_index, frame_index, round(avg(value) OVER w, 6) AS rolling_mean, max(value) OVER w AS rolling_max FROM frames WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)", "frames"))
def rolling_timing(spark: SparkSession, d: str) -> DataFrame:
    return control.rolling(proxy.frames(spark, d), ["episode_index"], "frame_index", "value").select("episode_index", "frame_index", *r6("rolling_mean"), "rolling_max")


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT label, dim, vec_id, row_number() OVER (PARTITION BY label, dim ORDER BY vec_id) - 1 AS frame_index, round(CAST(v AS DOUBLE), 6) AS value FROM x""")
def series_long_form(spark: SparkSession, d: str) -> DataFrame:
    e = proxy.table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("dim", "v"))
    w = Window.partitionBy("label", "dim").orderBy("vec_id")
    return e.select("label", F.col("dim").cast("long").alias("dim"), "vec_id", (F.row_number().over(w) - 1).cast("long").alias("frame_index"), F.round(F.col("v").cast("double"), 6).alias("value"))


ANCHOR_GAP_US = 24 * 3600 * 1_000_000


@query(with_views(f"""n AS (SELECT stream, topic, count(*) AS c FROM messages GROUP BY 1, 2), a AS (SELECT stream, arg_min(topic, (-c, topic)) AS topic FROM n GROUP BY 1),
t AS (SELECT stream, t_us, CASE WHEN t_us - lag(t_us) OVER w > {ANCHOR_GAP_US} THEN 1 ELSE 0 END AS o FROM messages JOIN a USING (stream, topic) WINDOW w AS (PARTITION BY stream ORDER BY t_us)),
g AS (SELECT stream, t_us, sum(o) OVER (PARTITION BY stream ORDER BY t_us) AS segment FROM t), e AS (SELECT stream, CAST(segment AS BIGINT) AS segment, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS length FROM g GROUP BY 1, 2)
SELECT e.stream, segment, start_us, end_us, length, count(m.id) AS messages, count(DISTINCT m.topic) AS topics FROM e JOIN messages m ON m.stream = e.stream AND m.t_us BETWEEN start_us AND end_us GROUP BY ALL""", "messages"))
def log_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of every stream by gaps of its most frequent topic, with the messages of all topics that they hold."""
    m = proxy.messages(spark, d)
    n = m.groupBy(F.col("stream").alias("file"), "topic").agg(F.count(F.lit(1)).alias("messages"))
    anchors = anchor_topics(n.withColumn("schema_name", F.lit("plain"))).withColumnRenamed("file", "stream")
    e = gap_episodes(m.join(anchors, ["stream", "topic"]), ["stream"], "t_us", ANCHOR_GAP_US)
    met = in_windows(m, e, ["stream"], "t_us").groupBy("stream", "segment", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "length")
    return met.agg(F.count("id").alias("messages"), F.count_distinct("topic").alias("topics"))
