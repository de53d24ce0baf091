"""Queries over labels, statistics, and merging of datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe import proxy
from epiframe.functions import control, kernels
from epiframe.operators import datasets as D
from epiframe.operators import stats as ST
from epiframe.operators import tables
from epiframe.plans.registry import query
from epiframe.proxy import table, with_views

_STAT = ("min", "max", "mean", "std", *ST.QUANTILES)
_Q_SQL = ", ".join(f"round(quantile_cont({{v}}, {p}), 6) AS {n}" for n, p in ST.QUANTILES.items())


def rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _STAT if c in df.columns], "count")


@query(with_views("SELECT episode_index, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS count, " + _Q_SQL.format(v="value") + " FROM frames GROUP BY 1", "frames"))
def feature_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ST.feature_stats(proxy.frames(spark, d), ["episode_index"], "value"), ["episode_index"])


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)\nSELECT label, dim, round(min(v), 6) AS min, round(max(v), 6) AS max, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(v) AS count, " + _Q_SQL.format(v="v") + " FROM x GROUP BY 1, 2")
def vector_feature_stats(spark: SparkSession, d: str) -> DataFrame:
    out = ST.vector_stats(table(spark, d, "embeddings"), ["label"], "embedding").withColumn("dim", F.col("dim").cast("long"))
    return rounded(out, ["label", "dim"])


@query("""WITH p AS (SELECT l_suppkey, min(l_quantity) AS mn, max(l_quantity) AS mx, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, count(*) AS c, quantile_cont(l_quantity, 0.5) AS q FROM lineitem GROUP BY 1),
g AS (SELECT p.*, s_nationkey AS nation FROM p JOIN supplier ON s_suppkey = l_suppkey), t AS (SELECT nation, sum(c * m) / sum(c) AS mm FROM g GROUP BY 1)
SELECT nation, min(mn) AS min, max(mx) AS max, round(any_value(mm), 6) AS mean, round(sqrt(greatest(0.0, sum(c * (s * s + (m - mm) * (m - mm))) / sum(c))), 6) AS std, CAST(sum(c) AS BIGINT) AS count, round(sum(c * q) / sum(c), 6) AS q50 FROM g JOIN t USING (nation) GROUP BY 1""")
def merge_partial_stats(spark: SparkSession, d: str) -> DataFrame:
    parts = ST.feature_stats(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity").drop("q01", "q10", "q90", "q99")
    parts = parts.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey").drop("l_suppkey")
    return rounded(ST.merge_stats(parts, ["nation"]), ["nation"])


@query("SELECT l_returnflag, count(l_extendedprice) AS count, TRUE AS within FROM lineitem GROUP BY 1")
def sketched_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of return flags from sketches of their suppliers, and whether their ranks, counted over all lines, are
    within the stated error (of sketches a quarter the size, so that chance does not decide)."""
    lines = table(spark, d, "lineitem")
    told = ST.merge_sketches(ST.value_sketches(lines, ["l_returnflag", "l_suppkey"], "l_extendedprice", 4 * ST.SKETCH_K), ["l_returnflag"])
    errors = ST.quantile_errors(lines, ["l_returnflag"], "l_extendedprice", told)
    return told.join(errors, "l_returnflag").select("l_returnflag", "count", (F.col("worst_error") <= ST.rank_error()).alias("within"))


_LENGTHS = "n AS (SELECT episode_index, count(*) AS length FROM frames GROUP BY 1)"


@query(with_views(_LENGTHS + "\nSELECT episode_index, length - 1 AS max, round((length - 1) / 2.0, 6) AS mean, round(sqrt((CAST(length AS DOUBLE) * length - 1) / 12), 6) AS std, round((length - 1) * CAST(0.10 AS DOUBLE), 6) AS q10, round((length - 1) * CAST(0.99 AS DOUBLE), 6) AS q99 FROM n", "frames"))
def sequential_stats(spark: SparkSession, d: str) -> DataFrame:
    n = proxy.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return ST.sequential_stats(n, "length").select("episode_index", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q10", "q99")])


@query(with_views(_LENGTHS + """, c AS (SELECT row_number() OVER (ORDER BY episode_index) - 1 AS i, length, sum(length) OVER (ORDER BY episode_index) AS e FROM n), t AS (SELECT sum(length) AS t, sum(i * length) / sum(length) AS m FROM c)
SELECT CAST(max(i) AS DOUBLE) AS max, round(any_value(m), 6) AS mean, round(sqrt(sum(length * (i - m) * (i - m)) / any_value(t)), 6) AS std, CAST(any_value(t) AS BIGINT) AS count, """ + ", ".join(f"CAST(min(i) FILTER (e - 1 >= {p} * (t - 1)) AS DOUBLE) AS {q}" for q, p in ST.QUANTILES.items()) + " FROM c, t", "frames"))
def repeated_value_stats(spark: SparkSession, d: str) -> DataFrame:
    n = proxy.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return rounded(ST.repeated_stats(n, "episode_index", "length"), [])


@query(with_views(_LENGTHS + "\nSELECT episode_index, CAST(sum(length) OVER w - length AS BIGINT) AS from_index, CAST(sum(length) OVER w AS BIGINT) AS to_index FROM n WINDOW w AS (ORDER BY episode_index)", "frames"))
def cumulative_index(spark: SparkSession, d: str) -> DataFrame:
    n = proxy.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return D.cumulative_index(n).select("episode_index", "from_index", "to_index")


@query("""WITH f AS (SELECT p_type AS task, min(p_partkey) AS k FROM part GROUP BY 1), v AS (SELECT task, row_number() OVER (ORDER BY k) - 1 AS task_index FROM f)
SELECT p_partkey, task_index FROM part JOIN v ON task = p_type""")
def task_remap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.join(D.task_vocabulary(p, "p_type", ["p_partkey"]), "p_type").select("p_partkey", "task_index")


_SOURCES = "src AS (SELECT CASE WHEN episode_index % 3 = 0 THEN 1 ELSE 0 END AS source, episode_index, frame_index FROM frames)"


def sources(spark: SparkSession, d: str) -> DataFrame:
    return proxy.frames(spark, d).withColumn("source", F.when(F.col("episode_index") % 3 == 0, 1).otherwise(0)).select("source", "episode_index", "frame_index")


@query(with_views(_SOURCES + "\nSELECT source, episode_index, frame_index, dense_rank() OVER (ORDER BY source, episode_index) - 1 AS new_episode, row_number() OVER (ORDER BY source, episode_index, frame_index) - 1 AS index FROM src", "frames"))
def merge_union_renumber(spark: SparkSession, d: str) -> DataFrame:
    return D.merge_frames(sources(spark, d)).select("source", "episode_index", "frame_index", "new_episode", "index")


@query("""WITH s AS (SELECT s_suppkey AS source, s_nationkey % 2 AS f, CAST(10 + s_suppkey % 3 AS DOUBLE) AS fps, CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE 'r' || s_nationkey % 4 END AS robot, s_suppkey % 7 AS n FROM supplier), b AS (SELECT * FROM s WHERE source = (SELECT min(source) FROM s))
SELECT source, code FROM (SELECT s.source, unnest([CASE WHEN s.n <= 0 THEN 'empty_dataset' END, CASE WHEN s.f IS DISTINCT FROM b.f THEN 'format_mismatch' END, CASE WHEN abs(s.fps - b.fps) > 0.0001 THEN 'fps_mismatch' END, CASE WHEN s.robot IS DISTINCT FROM b.robot THEN 'robot_mismatch' END]) AS code FROM s, b) WHERE code IS NOT NULL""")
def merge_preflight_conflicts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("source"), (F.col("s_nationkey") % 2).alias("format_id"), (10 + F.col("s_suppkey") % 3).cast("double").alias("fps"), F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("r"), F.col("s_nationkey") % 4)).alias("robot_type"),
        (F.col("s_suppkey") % 7).alias("n_episodes"), F.lit(1).alias("n_schemas"), *[F.lit("x").alias(c) for c in ("cameras", "features", "dialect", "schema_sig")])
    return D.preflight(s, s.orderBy("source").limit(1))


def label_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    t = F.when(k % 3 == 0, "episode").when(k % 3 == 1, "interval").otherwise("frame")
    return table(spark, d, "labels").select(t.alias("target"), (k % 50).alias("episode_index"), (k % 7).cast("double").alias("start_s"), (k % 7 + 2).cast("double").alias("end_s"), (k % 11).alias("frame_index"), (k % 7).alias("quality_score"), k.alias("label_id"))


_LABELS = """WITH l AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'episode' WHEN 1 THEN 'interval' ELSE 'frame' END AS target, doc_id % 50 AS episode_index, CAST(doc_id % 7 AS DOUBLE) AS start_s, CAST(doc_id % 7 + 2 AS DOUBLE) AS end_s, doc_id % 11 AS frame_index, doc_id % 7 AS quality_score, doc_id AS label_id FROM labels),
i AS (SELECT *, target || '|' || episode_index || '|' || CASE target WHEN 'frame' THEN frame_index || '|' || start_s WHEN 'interval' THEN start_s || '|' || end_s ELSE '' END AS ident FROM l)\n"""


@query(_LABELS + "SELECT label_id FROM i WHERE label_id % 10 <> 3 AND ident NOT IN (SELECT ident FROM i WHERE label_id % 10 = 3) UNION ALL SELECT label_id FROM i WHERE label_id % 10 = 3")
def label_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = label_rows(spark, d)
    return D.upsert_labels(rows.where("label_id % 10 <> 3"), rows.where("label_id % 10 = 3")).select("label_id")


@query(_LABELS + "SELECT label_id FROM i WHERE ident NOT IN (SELECT ident FROM i WHERE label_id % 10 = 4)")
def label_delete(spark: SparkSession, d: str) -> DataFrame:
    rows = label_rows(spark, d)
    return D.delete_labels(rows, rows.where("label_id % 10 = 4")).select("label_id")


@query(_LABELS + "SELECT label_id, 'quality_score' AS rule FROM i WHERE quality_score NOT BETWEEN 1 AND 5")
def label_violations(spark: SparkSession, d: str) -> DataFrame:
    return D.label_violations(label_rows(spark, d)).select("label_id", "rule")


@query("SELECT tag, count(*) AS count FROM (SELECT unnest([source, lang]) AS tag FROM documents) GROUP BY 1 ORDER BY count DESC, tag LIMIT 5")
def label_stats_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent tags, which is the report's feature."""
    return D.tag_counts(table(spark, d, "documents").select(F.array("source", "lang").alias("tags")))


@query("SELECT l.doc_id, row_number() OVER (ORDER BY l.doc_id) - 1 AS new_index, quality FROM labels l JOIN documents d USING (doc_id) WHERE lang = 'en'")
def labels_remap(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the kept episodes under their new numbers; others go."""
    kept = table(spark, d, "documents").where("lang = 'en'").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_semi")
    new = tables.numbered(kept, F.floor(F.col("doc_id") / 65536), ["doc_id"], "new_index")
    return tables.remap_episodes(table(spark, d, "labels"), new, "doc_id").select("doc_id", "new_index", "quality")


@query("""WITH w AS (SELECT o_custkey AS stream, CAST(epoch_us(min(o_orderdate)) AS BIGINT) AS a, CAST(epoch_us(max(o_orderdate)) AS BIGINT) AS b FROM orders GROUP BY 1)
SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN w ON w.stream = o_custkey AND epoch_us(l_shipdate) BETWEEN a AND b""")
def window_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Messages within the window of their own stream: equal on the stream, then by range."""
    from epiframe.operators.intervals import within

    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")
    o = table(spark, d, "orders")
    w = o.withColumn("t", us("o_orderdate")).groupBy(F.col("o_custkey").alias("stream")).agg(F.min("t").alias("start"), F.max("t").alias("end"))
    m = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("stream"), "o_orderkey", "l_linenumber", us("l_shipdate").alias("t"))
    return within(m, w, "stream", "t").select("o_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_anti(spark: SparkSession, d: str) -> DataFrame:
    return tables.missing_from(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


_TOPICS = ["/camera/rgb/compressed", "/joint_states", "/arm/pose", "/camera_info", "/tf", "/front/image"]
_SCHEMAS = ["sensor_msgs/CompressedImage", "sensor_msgs/JointState", "foxglove.PoseInFrame", None, "tf2_msgs/TFMessage", "sensor_msgs.Image"]


@query(f"""WITH t AS (SELECT event_id, ({_TOPICS!r})[CAST(event_id % 6 + 1 AS INTEGER)] AS t, ([{', '.join('NULL' if s is None else repr(s) for s in _SCHEMAS)}])[CAST(event_id % 6 + 1 AS INTEGER)] AS n FROM events),
l AS (SELECT event_id, lower(t) AS t, lower(coalesce(n, '')) AS n FROM t)
SELECT event_id, CASE WHEN contains(t, 'camera_info') OR contains(n, 'calibration') THEN false ELSE contains(n, 'compressedimage') OR n LIKE '%.image' OR n LIKE '%rawimage' OR (contains(t, 'compressed') AND (contains(t, 'camera') OR contains(t, 'image') OR contains(t, 'rgb'))) END AS image,
contains(t, 'pose') OR contains(n, 'poseinframe') OR contains(t, 'joint') OR contains(t, 'state') OR contains(t, 'action') OR contains(t, 'qpos') OR contains(t, 'proprio') OR contains(n, 'jointstate') OR contains(n, 'float64multiarray') AS joint FROM l""")
def topic_classify(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % 6).cast("int"))
    e = table(spark, d, "events").select("event_id", pick(_TOPICS).alias("t"), pick(_SCHEMAS).alias("n"))
    return e.select("event_id", D.is_image_topic(F.col("t"), F.col("n")).alias("image"), D.is_joint_topic(F.col("t"), F.col("n")).alias("joint"))


@query("""WITH x AS (SELECT p_partkey, p_retailprice % 200 AS s50, p_retailprice % 200 + p_size AS s90, 105.0::DOUBLE + p_size % 45 AS d50, 190.0::DOUBLE + p_size % 35 AS d90 FROM part),
n AS (SELECT *, greatest(0.001, least(0.999, s50 / 255.0)) AS x50, greatest(0.001, least(0.999, d50 / 255.0)) AS y50 FROM x),
m AS (SELECT *, least(0.999, greatest(x50 + 0.001, least(0.999, s90 / 255.0))) AS x90, least(0.999, greatest(y50 + 0.001, least(0.999, d90 / 255.0))) AS y90 FROM n),
g AS (SELECT *, greatest(0.72, least(1.35, ln(y50 / y90) / ln(x50 / x90))) AS gm FROM m)
SELECT p_partkey, round(CASE WHEN s90 - s50 < 8 THEN greatest(0.72, least(1.38, d50 / greatest(s50, 1.0))) ELSE greatest(0.72, least(1.38, y90 / pow(x90, gm))) END, 6) AS gain, round(CASE WHEN s90 - s50 < 8 THEN 1.0 ELSE gm END, 6) AS gamma FROM g""")
def brightness_curve(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    s50, size = F.col("p_retailprice") % 200, F.col("p_size")
    gain, gamma = control.brightness_curve(s50, s50 + size, 105.0 + size % 45, 190.0 + size % 35)
    return p.select("p_partkey", F.round(gain, 6).alias("gain"), F.round(gamma, 6).alias("gamma"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, 2 + l_linenumber * 2 AS s, l_quantity * 10 AS lat, l_linenumber * 5.0 AS hz FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(greatest(1, least(s - 1, s - greatest(1, ceil((greatest(0.0, lat) + 30) * hz / 1000)))) AS BIGINT) AS request_after FROM x""")
def prefetch_steps(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", control.request_after(2 + n * 2, F.col("l_quantity") * 10, n * 5.0).alias("request_after"))


@query("""SELECT c_custkey AS k, 'saved' AS origin FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT DISTINCT o_custkey, 'found' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)""")
def config_union_override(spark: SparkSession, d: str) -> DataFrame:
    """Saved and discovered entries as one list, in which the saved ones win."""
    saved = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"))
    return kernels.union_override(saved, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH s AS (SELECT event_type, min(epoch_us(ts)) AS t0, max(epoch_us(ts)) - min(epoch_us(ts)) AS span FROM events GROUP BY 1)
SELECT event_type, CAST(sum(greatest(span, 1) + 3000000) OVER (ORDER BY event_type) - (greatest(span, 1) + 3000000) AS BIGINT) AS starts_at FROM s""")
def retiming_cursor(spark: SparkSession, d: str) -> DataFrame:
    """Where each recording starts in a merged log: after the spans of those before it and pauses of 3 s."""
    s = proxy.messages(spark, d).groupBy(F.col("topic").alias("event_type")).agg((F.max("t_us") - F.min("t_us")).alias("span"))
    return kernels.retimed(s, "event_type").select("event_type", "starts_at")
