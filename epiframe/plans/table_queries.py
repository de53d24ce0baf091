"""Queries of column rewrites, statistics by new keys, summaries, action kernels and gripper detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe import proxy
from epiframe.functions import kernels as K
from epiframe.operators import datasets as D
from epiframe.operators import detectors, tables, visual
from epiframe.plans.registry import query
from epiframe.proxy import FPS, table, with_views


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS action FROM lineitem")
def series_pick(spark: SparkSession, d: str) -> DataFrame:
    """The action is picked by the first exact name among fallbacks."""
    li = table(spark, d, "lineitem")
    name = tables.pick_series(li, None, ("action", "l_quant", "l_quantity", "l_tax"))
    return li.select("l_orderkey", "l_linenumber", F.col(name).cast("int").alias("action"))


@query("SELECT l_orderkey, CAST(l_linenumber * 2 AS INTEGER) AS l_linenumber, l_tax FROM lineitem")
def column_replace(spark: SparkSession, d: str) -> DataFrame:
    li = tables.replace_column(table(spark, d, "lineitem"), "l_linenumber", F.col("l_linenumber") * 2.0)
    return tables.replace_column(li, "no_such", F.lit(1)).select("l_orderkey", "l_linenumber", "l_tax")


@query("SELECT CAST(p_size AS BIGINT) AS p_size, p_brand, CAST(NULL AS DOUBLE) AS weight, CAST(p_partkey AS VARCHAR) AS p_partkey FROM part")
def schema_align(spark: SparkSession, d: str) -> DataFrame:
    fields = (("p_size", T.LongType()), ("p_brand", T.StringType()), ("weight", T.DoubleType()), ("p_partkey", T.StringType()))
    return tables.align(table(spark, d, "part"), T.StructType([T.StructField(n, t) for n, t in fields]))


@query('SELECT s_suppkey AS "sSuppkey", s_name AS "sName", s_acctbal AS "sAcctbal" FROM supplier')
def camel_columns(spark: SparkSession, d: str) -> DataFrame:
    return tables.to_camel(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN contains(lower(p_brand), '1') AND NOT contains(lower(p_brand), '5') THEN 0 END, CASE WHEN contains(lower(p_type), '1') AND NOT contains(lower(p_type), '5') THEN 1 END, CASE WHEN contains(lower(p_name), '1') AND NOT contains(lower(p_name), '5') THEN 2 END], lambda x: x IS NOT NULL), ',') AS dims FROM part")
def dims_by_name(spark: SparkSession, d: str) -> DataFrame:
    dims = tables.kept_dims(F.array("p_brand", "p_type", "p_name"), ("1",), ("5",))
    return table(spark, d, "part").select("p_partkey", F.array_join(dims.cast("array<string>"), ",").alias("dims"))


@query("SELECT s_suppkey, array_to_string(list_sort(list_distinct(['cam_' || s_nationkey % 3, 'cam_' || s_suppkey % 3, 'wrist'])), ',') AS cameras FROM supplier")
def camera_union(spark: SparkSession, d: str) -> DataFrame:
    cam = lambda c: F.concat(F.lit("cam_"), (F.col(c) % 3).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(tables.camera_keys(F.array(cam("s_nationkey")), F.array(cam("s_suppkey"), F.lit("wrist"))), ",").alias("cameras"))


@query(with_views("""s AS (SELECT CASE WHEN episode_index % 3 = 0 THEN 1 ELSE 0 END AS source, episode_index, max(value) AS most FROM frames GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (ORDER BY source, episode_index) - 1 AS n FROM s)
SELECT source, n AS episode_index, most FROM m WHERE episode_index % 7 <> 0""", "frames"))
def stats_rekey(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.frames(spark, d).withColumn("source", F.when(F.col("episode_index") % 3 == 0, 1).otherwise(0))
    merged = D.merge_frames(f.select("source", "episode_index", "frame_index")).select("source", "episode_index", "new_episode").distinct()
    return tables.rekey_stats(f.groupBy("source", "episode_index").agg(F.max("value").alias("most")), merged.where("episode_index % 7 <> 0")).select("source", "episode_index", "most")


@query("""WITH v AS (SELECT p_type AS task, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS i FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT p_partkey, coalesce(i, -1) AS task_index FROM part LEFT JOIN v ON task = p_type""")
def task_remap_known(spark: SparkSession, d: str) -> DataFrame:
    """Tasks outside the vocabulary keep what they had, here -1."""
    p = table(spark, d, "part").withColumn("task_index", F.lit(-1).cast("long"))
    return D.remap_tasks(p, D.task_vocabulary(p.where("p_size <= 25"), "p_type", ["p_partkey"]), "p_type").select("p_partkey", "task_index")


@query(with_views("SELECT count(*) AS episodes, count(*) FILTER (coalesce(manual_decision, auto_decision) = 'pass') AS n_pass, count(*) FILTER (coalesce(manual_decision, auto_decision) = 'review') AS n_review, count(*) FILTER (coalesce(manual_decision, auto_decision) = 'quarantine') AS n_quarantine, round(100.0 * count(coalesce(manual_decision, auto_decision)) / count(*), 3) AS reviewed_percent FROM episodes", "episodes"))
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    from epiframe.operators.quality import effective_decision

    return tables.review_summary(effective_decision(proxy.episodes(spark, d)))


@query(with_views("SELECT count(*) AS episodes, CAST(sum(n) AS BIGINT) AS frames, max(c) AS max_cameras FROM (SELECT count(*) AS n, CAST(count(DISTINCT topic) AS INTEGER) AS c FROM frames GROUP BY episode_index)", "frames"))
def dataset_totals(spark: SparkSession, d: str) -> DataFrame:
    return tables.totals(proxy.frames(spark, d).groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"), F.collect_set("topic").alias("cameras")))


@query("WITH x AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT label, dim, round(min(v), 6) AS low, round(greatest(max(v), min(v) + 1e-9), 6) AS high FROM x GROUP BY 1, 2")
def display_range(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "value")).select("label", F.col("dim").cast("long").alias("dim"), F.col("value").cast("double").alias("value"))
    return tables.display_range(x, ["label", "dim"]).select("label", "dim", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def reclaimed_bytes(spark: SparkSession, d: str) -> DataFrame:
    return tables.reclaimed(table(spark, d, "documents").select("source", F.col("n_chars").alias("bytes")), ["source"])


@query(with_views("SELECT episode_index, frame_index, value FROM frames WHERE frame_index < 9", "frames"))
def head_preview(spark: SparkSession, d: str) -> DataFrame:
    """The first nine frames of each episode, which is the preview's feature."""
    return tables.head_frames(proxy.frames(spark, d), 9).select("episode_index", "frame_index", "value")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '1,2' WHEN p_size % 3 = 1 THEN '7,7' END AS tolerance FROM part")
def tolerance_broadcast(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    given = F.when(k == 0, F.array(F.lit(1), F.lit(2))).when(k == 1, F.array(F.lit(7))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    return table(spark, d, "part").select("p_partkey", F.array_join(K.broadcast_tolerance(given, F.lit(2)).cast("array<string>"), ",").alias("tolerance"))


@query(with_views("""c AS (SELECT *, greatest(1.0, least(60.0, value)) AS clamped FROM frames), b AS (SELECT *, lag(clamped) OVER (PARTITION BY episode_index ORDER BY frame_index) AS before FROM c),
v AS (SELECT *, CASE WHEN value < 1 OR value > 60 THEN 'limit' WHEN abs(clamped - before) > 40 THEN 'step' END AS kind FROM b) SELECT episode_index, frame_index, kind FROM v WHERE kind IS NOT NULL""", "frames"))
def strict_action_check(spark: SparkSession, d: str) -> DataFrame:
    return K.strict_violations(proxy.frames(spark, d), ["episode_index"], "frame_index", "value", 1.0, 60.0, 40.0).select("episode_index", "frame_index", "kind")


@query("SELECT c_custkey, c_mktsegment AS image, 'depth' AS missing FROM customer")
def observation_mapping(spark: SparkSession, d: str) -> DataFrame:
    seen, missing = K.map_observation(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name")), {"image": "segment", "far": "depth"})
    return table(spark, d, "customer").select("c_custkey", F.try_element_at(seen, F.lit("image")).alias("image"), F.array_join(missing, ",").alias("missing"))


@query("SELECT p_partkey, array_to_string(list_transform(range(0, p_size % 4), lambda i: CASE WHEN i = 0 THEN p_brand ELSE 'd' || i END), ',') AS names FROM part")
def name_padding(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(K.padded_names(F.array("p_brand"), (F.col("p_size") % 4).cast("int")), ",").alias("names"))


_MOVES = """m AS (SELECT episode_index, frame_index, value - lag(value) OVER (PARTITION BY episode_index ORDER BY frame_index) AS step FROM frames), t AS (SELECT * FROM m WHERE abs(step) >= 20), n AS (SELECT episode_index, count(*) / 10.0 AS duration FROM frames GROUP BY 1)"""


@query(with_views(_MOVES + """
SELECT t.episode_index, 'manipulation/gripper_chatter' AS issue_code, round(min(frame_index) / 10.0, 6) AS start_s, round(least(min(duration), (max(frame_index) + 1) / 10.0), 6) AS end_s FROM t JOIN n USING (episode_index) GROUP BY t.episode_index HAVING count(*) / greatest(min(duration), 0.000001) > 4""", "frames"))
def gripper_chatter(spark: SparkSession, d: str) -> DataFrame:
    f = detectors.chatter(proxy.frames(spark, d), FPS, delta=20.0)
    return f.select("episode_index", "issue_code", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(with_views(_MOVES + """,
l AS (SELECT *, lead(frame_index, 2) OVER w AS f3, lead(step, 1) OVER w AS s2, lead(step, 2) OVER w AS s3 FROM t WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)),
x AS (SELECT episode_index, min(frame_index) AS f1, arg_min(f3, frame_index) AS f3 FROM l WHERE f3 - frame_index <= 50 AND sign(step) = sign(s3) AND sign(step) <> sign(s2) GROUP BY 1)
SELECT episode_index, 'manipulation/regrasp_candidate' AS issue_code, round(greatest(0.0, (f1 - 1) / 10.0), 6) AS start_s, round(least(duration, (f3 + 1) / 10.0), 6) AS end_s FROM x JOIN n USING (episode_index)""", "frames"))
def regrasp_candidates(spark: SparkSession, d: str) -> DataFrame:
    f = detectors.regrasp(proxy.frames(spark, d), FPS, delta=20.0)
    return f.select("episode_index", "issue_code", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(with_views("""x AS (SELECT episode_index, frame_index, CASE WHEN id % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS v FROM frames WHERE episode_index % 11 <> 0),
e AS (SELECT episode_index, count(*) + CASE WHEN episode_index % 5 = 0 THEN 40 ELSE 0 END AS expected FROM frames GROUP BY 1), s AS (SELECT episode_index, count(*) AS n, min(frame_index) FILTER (NOT isfinite(v)) AS a FROM x GROUP BY 1), j AS (SELECT * FROM e LEFT JOIN s USING (episode_index))
SELECT episode_index, 'integrity/missing_action' AS issue_code FROM j WHERE n IS NULL UNION ALL SELECT episode_index, 'integrity/non_finite_signal' FROM j WHERE a IS NOT NULL
UNION ALL SELECT episode_index, 'integrity/signal_length_mismatch' FROM j WHERE expected > 0 AND abs(n - expected) > greatest(2, CAST(round_even(expected * 0.1, 0) AS BIGINT))""", "frames"))
def integrity_findings(spark: SparkSession, d: str) -> DataFrame:
    f = proxy.frames(spark, d)
    e = f.groupBy("episode_index").agg((F.count(F.lit(1)) + F.when(F.first("episode_index") % 5 == 0, 40).otherwise(0)).alias("length"))
    x = f.where("episode_index % 11 <> 0").withColumn("value", F.when(F.col("id") % 97 == 0, float("nan")).otherwise(F.col("value")))
    return detectors.integrity(x, e, FPS).select("episode_index", "issue_code")


@query(with_views("""m AS (SELECT episode_index, frame_index, x.c AS code FROM (SELECT episode_index, frame_index, unnest([{'c': 'visual/dark', 'f': value * 2 < 40}, {'c': 'visual/overexposed', 'f': value * 2 > 245}, {'c': 'visual/blur', 'f': k < 35}]) AS x FROM frames) WHERE x.f),
g AS (SELECT *, frame_index - row_number() OVER (PARTITION BY episode_index, code ORDER BY frame_index) AS g FROM m),
r AS (SELECT episode_index, code, min(frame_index) AS a, max(frame_index) + 1 AS b FROM g GROUP BY episode_index, code, g HAVING count(*) >= 5),
o AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY episode_index, code ORDER BY a) > 2 THEN 1 ELSE 0 END AS o FROM r), u AS (SELECT *, sum(o) OVER (PARTITION BY episode_index, code ORDER BY a) AS u FROM o), n AS (SELECT episode_index, count(*) / 10.0 AS duration FROM frames GROUP BY 1)
SELECT u.episode_index, code AS issue_code, round(greatest(0.0, min(a) / 10.0 - 0.1), 6) AS start_s, round(least(min(duration), max(b) / 10.0 + 0.1), 6) AS end_s FROM u JOIN n USING (episode_index) GROUP BY u.episode_index, code, u""", "frames"))
def visual_findings(spark: SparkSession, d: str) -> DataFrame:
    """Exposure and blur findings of one camera, whose luma and sharpness the messages' numbers stand for."""
    m = proxy.frames(spark, d).select("episode_index", F.lit("c").alias("camera_key"), "frame_index", (F.col("value") * 2).alias("mean_luma"), F.col("k").alias("blur"))
    return visual.exposure_findings(m, FPS).select("episode_index", "issue_code", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query("SELECT p_partkey, (contains(lower(p_name), 'base') OR contains(lower(p_name), 'head') OR contains(lower(p_name), 'main') OR contains(lower(p_name), 'front') OR contains(lower(p_name), 'overhead')) AND NOT (contains(lower(p_name), 'wrist') OR contains(lower(p_name), 'hand') OR contains(lower(p_name), 'eef')) AS fixed FROM (SELECT p_partkey, (['Base_', 'cam_HEAD', 'wrist_front', 'side', 'overhead_hand', 'main'])[p_partkey % 6 + 1] || p_size AS p_name FROM part)")
def static_cameras(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Base_", "cam_HEAD", "wrist_front", "side", "overhead_hand", "main")])
    name = F.concat(F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", visual.is_static_camera(name).alias("fixed"))


@query(with_views("""m AS (SELECT episode_index, frame_index, value AS x, k / 10.0 AS y, frame_index > 0 AND id % 13 <> 0 AS ok FROM frames)
SELECT episode_index, frame_index, CASE WHEN ok AND lag(ok) OVER w THEN round(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 6) END AS change FROM m WINDOW w AS (PARTITION BY episode_index ORDER BY frame_index)""", "frames"))
def camera_motion_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes of motion vectors, for which two numbers of each message stand; some pairs are not reliable."""
    ok = (F.col("frame_index") > 0) & (F.col("id") % 13 != 0)
    m = proxy.frames(spark, d).select("episode_index", F.lit("head").alias("camera_key"), "frame_index", F.when(ok, F.array("value", F.col("k") / 10.0)).alias("motion"))
    return visual.motion_changes(m).select("episode_index", "frame_index", F.round("change", 6).alias("change"))


@query(with_views("""n AS (SELECT episode_index, topic, count(*) AS messages FROM frames GROUP BY 1, 2)
SELECT episode_index AS file, arg_min(topic, (CASE WHEN topic LIKE '%k' THEN 0 ELSE 2 END, -messages, topic)) AS topic FROM (SELECT episode_index, topic, messages FROM n) GROUP BY 1""", "frames"))
def anchor_topics(spark: SparkSession, d: str) -> DataFrame:
    """The topic that splits a log; here messages of topics that end in k are of a joint type."""
    n = proxy.frames(spark, d).groupBy(F.col("episode_index").alias("file"), "topic").agg(F.count(F.lit(1)).alias("messages"))
    return D.anchor_topics(n.withColumn("schema_name", F.when(F.col("topic").endswith("k"), "JointState").otherwise("plain")))


@query(with_views("""x AS (SELECT episode_index, frame_index, CASE WHEN id % 97 = 0 THEN NULL ELSE value END AS v FROM frames),
a AS (SELECT episode_index, count(*) AS n, min(frame_index) FILTER (v IS NULL) AS a, max(frame_index) FILTER (v IS NULL) AS b FROM x GROUP BY 1),
s AS (SELECT episode_index, count(*) AS n FROM frames WHERE episode_index % 3 <> 0 OR frame_index % 2 = 0 GROUP BY 1)
SELECT episode_index, 'integrity/non_finite_signal' AS issue_code, 'action' AS signal_key, round(a / 10.0, 6) AS start_s, round(least(n / 10.0, (b + 1) / 10.0), 6) AS end_s FROM a WHERE a IS NOT NULL
UNION ALL SELECT episode_index, 'integrity/signal_length_mismatch', 'observation.state', NULL, NULL FROM a JOIN s USING (episode_index) WHERE abs(s.n - a.n) > greatest(2, CAST(round_even(a.n * 0.1, 0) AS BIGINT))
UNION ALL SELECT episode_index, 'integrity/action_state_length_mismatch', NULL, NULL, NULL FROM a JOIN s USING (episode_index) WHERE abs(s.n - a.n) > greatest(2, CAST(round_even(a.n * 0.1, 0) AS BIGINT))""", "frames"))
def vector_signal_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Findings on two vector signals, of which the state lacks every second frame of every third episode."""
    f = proxy.frames(spark, d)
    v = F.when(F.col("id") % 97 != 0, F.col("value"))
    action = f.select("episode_index", F.lit("action").alias("signal_key"), "frame_index", F.array(F.lit(1.0), v).alias("value"))
    state = f.where("episode_index % 3 <> 0 or frame_index % 2 = 0").select("episode_index", F.lit("observation.state").alias("signal_key"), "frame_index", F.array("value").alias("value"))
    e = f.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    got = detectors.signal_integrity(action.unionByName(state), e, FPS, ("action", "observation.state"))
    return got.select("episode_index", "issue_code", "signal_key", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))
