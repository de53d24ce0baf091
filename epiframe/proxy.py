"""The driver's tables seen as domain tables: frames, episodes, findings, reviews and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream, topic, id, t_us, value, k) from events; t_us counts from 1970 whatever the session's zone is."""
    e = table(spark, sf_dir, "events")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return e.select(F.col("user_id").alias("stream"), F.col("event_type").alias("topic"), F.col("event_id").alias("id"), t.alias("t_us"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_index, frame_index, value, k, topic, id): one stream is an episode, its messages in order are frames."""
    order = Window.partitionBy("stream").orderBy("t_us", "id")
    m = messages(spark, sf_dir)
    return m.select(F.col("stream").alias("episode_index"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"), "value", "k", "topic", "id")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding per order line: severity by return flag, interval by line number and quantity."""
    li = table(spark, sf_dir, "lineitem")
    severity = F.when(F.col("l_returnflag") == "R", "error").when(F.col("l_returnflag") == "A", "warning").otherwise("info")
    start = F.col("l_linenumber").cast("double")
    return li.select(
        F.col("l_orderkey").alias("episode_index"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("finding_id"), F.concat("l_returnflag", F.lit("/"), "l_linestatus").alias("issue_code"),
        severity.alias("severity"), start.alias("start_s"), (start + F.col("l_quantity") / 20).alias("end_s"), (1 - F.col("l_discount")).alias("confidence"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of some findings."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_discount") >= 0.08)
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("finding_id"), F.when(F.col("l_tax") >= 0.04, "rejected").otherwise("accepted").alias("review_status"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes from orders: decisions by status and priority, duration and scores by price."""
    o = table(spark, sf_dir, "orders")
    auto = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "review").otherwise("quarantine")
    manual = F.when(F.col("o_orderpriority").startswith("1"), "pass").when(F.col("o_orderpriority").startswith("5"), "quarantine")
    return o.select(
        F.col("o_orderkey").alias("episode_index"), F.col("o_orderpriority").alias("task_text"), F.when(F.col("o_orderstatus") == "P", "invalid").otherwise("valid").alias("integrity_status"), auto.alias("auto_decision"), manual.alias("manual_decision"),
        (F.col("o_totalprice") % 100).alias("quality_score"), (F.col("o_totalprice") % 77).alias("usable_ratio"), (F.col("o_custkey") % 101).cast("double").alias("coverage"), F.lit(8.0).alias("duration"),
    )


#: The same views for DuckDB, as common table expressions.
SQL = {
    "messages": "messages AS (SELECT user_id AS stream, event_type AS topic, event_id AS id, epoch_us(ts) AS t_us, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)",
    "frames": "frames AS (SELECT stream AS episode_index, row_number() OVER (PARTITION BY stream ORDER BY t_us, id) - 1 AS frame_index, value, k, topic, id FROM messages)",
    "findings": """findings AS (SELECT l_orderkey AS episode_index, l_orderkey || '-' || l_linenumber AS finding_id, l_returnflag || '/' || l_linestatus AS issue_code,
        CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'info' END AS severity, CAST(l_linenumber AS DOUBLE) AS start_s, l_linenumber + l_quantity / 20 AS end_s, 1 - l_discount AS confidence FROM lineitem)""",
    "reviews": "reviews AS (SELECT l_orderkey || '-' || l_linenumber AS finding_id, CASE WHEN l_tax >= 0.04 THEN 'rejected' ELSE 'accepted' END AS review_status FROM lineitem WHERE l_discount >= 0.08)",
    "episodes": """episodes AS (SELECT o_orderkey AS episode_index, o_orderpriority AS task_text, CASE WHEN o_orderstatus = 'P' THEN 'invalid' ELSE 'valid' END AS integrity_status,
        CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'review' ELSE 'quarantine' END AS auto_decision,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'pass' WHEN o_orderpriority LIKE '5%' THEN 'quarantine' END AS manual_decision,
        o_totalprice % 100 AS quality_score, o_totalprice % 77 AS usable_ratio, CAST(o_custkey % 101 AS DOUBLE) AS coverage, CAST(8.0 AS DOUBLE) AS duration FROM orders)""",
}


def with_views(body: str, *names: str) -> str:
    """``body`` (which may open with further expressions) after the named views."""
    need = [n for n in ("messages", "frames", "findings", "reviews", "episodes") if n in names or (n == "messages" and "frames" in names)]
    return "WITH " + ",\n".join(SQL[n] for n in need) + ("" if body.lstrip().upper().startswith("SELECT") else ",") + "\n" + body
