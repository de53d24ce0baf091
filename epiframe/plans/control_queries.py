"""Queries of sampling, control checks and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe import proxy
from epiframe.functions import kernels as K
from epiframe.operators import detectors, tables
from epiframe.plans.registry import query
from epiframe.plans.signal_queries import _HITS, _LOCAL
from epiframe.proxy import FPS, table, with_views


@query(with_views(_HITS + ",\n" + _LOCAL + """,
e AS (SELECT episode_index, frame_index, len(list_filter(range(2, len(sg) + 1), lambda i: sg[i] <> sg[i - 1])) AS rv, greatest(0.0, list_sum(list_transform(st, lambda x: abs(x))) - abs(w[-1] - w[1])) / greatest(span, 2.220446049250313e-16) AS ex FROM g),
k AS (SELECT hh.episode_index, hh.frame_index, hh.frame_index - row_number() OVER (PARTITION BY hh.episode_index ORDER BY hh.frame_index) AS grp FROM hh JOIN e ON e.episode_index = hh.episode_index AND e.frame_index = hh.frame_index WHERE hit AND rv >= 1 AND ex >= 0.5),
runs AS (SELECT episode_index, min(frame_index) AS a, max(frame_index) + 1 AS b FROM k GROUP BY episode_index, grp),
o AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY episode_index ORDER BY a) > 2 THEN 1 ELSE 0 END AS o FROM runs),
mg AS (SELECT *, sum(o) OVER (PARTITION BY episode_index ORDER BY a) AS m FROM o), n AS (SELECT episode_index, count(*) / 10.0 AS duration FROM frames GROUP BY 1)
SELECT episode_index, 'motion/jitter' AS issue_code, round(greatest(0.0, min(a) / 10.0 - 0.1), 6) AS start_s, round(least(min(duration), max(b) / 10.0 + 0.1), 6) AS end_s FROM mg JOIN n USING (episode_index) GROUP BY episode_index, m""", "frames"))
def motion_jitter(spark: SparkSession, d: str) -> DataFrame:
    f = detectors.jitter(proxy.frames(spark, d), FPS, accel_z=2, jerk_z=2)
    return f.select("episode_index", "issue_code", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(with_views("SELECT episode_index, frame_index FROM frames WHERE frame_index % 5 = 0", "frames"))
def stride_sampling(spark: SparkSession, d: str) -> DataFrame:
    return tables.every_nth(proxy.frames(spark, d), 5).select("episode_index", "frame_index")


@query("SELECT o_orderkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 25")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """25 episodes by a seeded digest: the sample is the feature."""
    return tables.sample_of(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 25, 7)


@query(with_views("""s AS (SELECT episode_index, string_agg(DISTINCT topic, ',' ORDER BY topic) AS cameras FROM frames GROUP BY 1)
SELECT cameras, count(*) AS episodes, count(*) = (SELECT count(*) FROM s) AS consistent FROM s GROUP BY 1""", "frames"))
def camera_set_equality(spark: SparkSession, d: str) -> DataFrame:
    return tables.set_groups(proxy.frames(spark, d), "episode_index", "topic").withColumnsRenamed({"members": "cameras", "keys": "episodes"})


@query("SELECT p_brand, count(DISTINCT sha256(concat_ws('|', p_type, CAST(p_size AS VARCHAR)))) AS signatures, count(DISTINCT sha256(concat_ws('|', p_type, CAST(p_size AS VARCHAR)))) = 1 AS same FROM part GROUP BY 1")
def schema_signature_set(spark: SparkSession, d: str) -> DataFrame:
    return tables.signatures(table(spark, d, "part"), "p_brand", F.col("p_type"), F.col("p_size"))


@query("SELECT vec_id, CASE WHEN label % 4 = 0 THEN 'horizon' WHEN label % 4 = 1 THEN 'width' WHEN len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 OR label % 4 = 2 THEN 'non_finite' END AS fault FROM embeddings")
def action_chunk_check(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of two rows each; a quarter of them short of a row, of a dimension, or spoiled."""
    v, k = F.col("embedding"), F.col("label") % 4
    spoiled = F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))
    chunk = F.when(k == 0, F.array(v)).when(k == 1, F.array(v, F.slice(v, 1, 63))).when(k == 2, F.array(v, spoiled)).otherwise(F.array(v, v))
    return table(spark, d, "embeddings").select("vec_id", K.chunk_faults(chunk, 2, 64).alias("fault"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, 4), lambda i: CAST(p_size AS VARCHAR)), ',') AS hold FROM part")
def hold_chunk(spark: SparkSession, d: str) -> DataFrame:
    """A baseline repeated over the horizon."""
    return table(spark, d, "part").select("p_partkey", F.array_join(K.hold_chunk(F.col("p_size").cast("string"), 4), ",").alias("hold"))


@query("SELECT vec_id, array_to_string(list_transform(list_reverse(embedding), lambda x: printf('%.4f', CAST(x AS DOUBLE))), ',') AS turned, 'j64' AS missing FROM embeddings")
def joint_reorder(spark: SparkSession, d: str) -> DataFrame:
    """All joints in the opposite order, and one that there is not."""
    e, names = table(spark, d, "embeddings"), F.array(*[F.lit(f"j{i}") for i in range(64)])
    v = K.reorder_joints(names, F.col("embedding"), [f"j{i}" for i in reversed(range(64))])
    return e.select("vec_id", F.array_join(F.transform(v, lambda x: F.format_string("%.4f", x.cast("double"))), ",").alias("turned"), F.array_join(K.missing_joints(names, ["j3", "j64"]), ",").alias("missing"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 3")
def event_log_tail(spark: SparkSession, d: str) -> DataFrame:
    return K.log_tail(table(spark, d, "conversations"), ["conv_id"], ["turn", "role"], 3).select("conv_id", "turn", "role")


@query("SELECT DISTINCT c_nationkey AS missing FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def recipe_integrity(spark: SparkSession, d: str) -> DataFrame:
    return K.undefined_references(table(spark, d, "customer"), "c_nationkey", table(spark, d, "supplier"), "s_nationkey")


@query(with_views("SELECT id, abs(1705000000000000 - t_us) <= 86400000000 AS fresh FROM messages", "messages"))
def timestamp_age(spark: SparkSession, d: str) -> DataFrame:
    return proxy.messages(spark, d).select("id", K.is_fresh(F.col("t_us"), 1705000000000000, 86400000000).alias("fresh"))


@query("SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0), 6) AS latency FROM lineitem")
def end_to_end_latency(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(K.latency("l_quantity", "l_discount", "l_tax"), 6).alias("latency"))


@query("SELECT 'demo_' || c_custkey AS name, row_number() OVER (ORDER BY length('demo_' || c_custkey), 'demo_' || c_custkey) - 1 AS place FROM customer")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    return tables.natural_order(table(spark, d, "customer").select(F.concat(F.lit("demo_"), F.col("c_custkey").cast("string")).alias("name")))


@query("SELECT l_suppkey AS finding, arg_max(l_returnflag, (l_orderkey * 100 + l_linenumber) * 10000 + l_partkey % 10000) AS status, count(*) AS entries FROM lineitem GROUP BY 1")
def review_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    """An append-only log of reviews: the last entry of each finding holds."""
    order = (F.col("l_orderkey") * 100 + F.col("l_linenumber")) * 10000 + F.col("l_partkey") % 10000
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("finding")).agg(F.max_by("l_returnflag", order).alias("status"), F.count(F.lit(1)).alias("entries"))


@query("SELECT p_brand AS id, count(*) > 1 AS repeated, NOT regexp_full_match(p_brand, '[A-Za-z][A-Za-z0-9_-]{0,63}') AS malformed FROM part GROUP BY 1")
def review_reason_validation(spark: SparkSession, d: str) -> DataFrame:
    return K.reason_faults(table(spark, d, "part"), "p_brand")


@query("""WITH a AS (SELECT label, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), b AS (SELECT j, avg(x) AS target FROM a WHERE j <= 60 GROUP BY 1)
SELECT label, round(max(abs(x - target)), 6) AS error, max(abs(x - target)) <= 0.4 AS reached, count(*) FILTER (target IS NULL) > 0 AS missing FROM a LEFT JOIN b USING (j) GROUP BY 1""")
def pose_error(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("joint", "value")).withColumn("value", F.col("value").cast("double"))
    b = a.where("joint < 60").groupBy("joint").agg(F.avg("value").alias("target"))
    return K.pose_errors(a, b, ["label"], 0.4).withColumn("error", F.round("error", 6))


@query(with_views("""n AS (SELECT episode_index, count(*) AS n FROM frames GROUP BY 1)
SELECT DISTINCT episode_index, CAST(round_even(i * (n - 1) / 7.0, 0) AS BIGINT) AS probe FROM n, (SELECT unnest(range(0, 8)) AS i)""", "frames"))
def probe_indices(spark: SparkSession, d: str) -> DataFrame:
    """Eight evenly spaced probes of each recording."""
    n = proxy.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))
    return n.select("episode_index", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.rint(i * (F.col("n") - 1) / 7.0).cast("long"))).alias("probe")).distinct()


@query("SELECT o_orderkey FROM orders, (SELECT max(o_orderdate) AS now FROM orders) WHERE date_diff('day', o_orderdate, now) > CASE WHEN o_orderstatus = 'F' THEN 400 ELSE 800 END")
def retention_ttl(spark: SparkSession, d: str) -> DataFrame:
    """What is older than its family's days to live."""
    o = table(spark, d, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))  # one row
    return K.expired(o.join(F.broadcast(now)), F.datediff("now", "o_orderdate"), F.col("o_orderstatus"), {"F": 400}, 800).select("o_orderkey")


@query(with_views("SELECT episode_index, n, action_n, abs(action_n - n) > greatest(2, n // 10) AS rejected FROM (SELECT episode_index, count(*) AS n, count(*) FILTER (k < 90) AS action_n FROM frames GROUP BY 1)", "frames"))
def payload_length_check(spark: SparkSession, d: str) -> DataFrame:
    n = proxy.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") < 90).alias("action_n"))
    return n.withColumn("rejected", K.payload_rejected(F.col("action_n"), F.col("n")))
