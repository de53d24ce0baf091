"""Labels, and merging of datasets: remaps, unions, preflight conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that tell image and joint topics by name.
IMAGE_WORDS = ("camera", "image", "rgb")
JOINT_WORDS = ("joint", "state", "action", "qpos", "proprio")
CONFLICTS = {"format_mismatch": "format_id", "fps_mismatch": "fps", "robot_mismatch": "robot_type", "camera_mismatch": "cameras", "feature_mismatch": "features", "dialect_mismatch": "dialect", "native_schema_mismatch": "schema_sig"}


def label_identity() -> Column:
    """What upsert and delete match by: an interval's span, a frame's number and time, else the episode."""
    ms = lambda c: F.bround(F.col(c), 3)
    none = F.lit(None).cast("double")
    t = F.coalesce("target", F.lit("episode"))
    return F.struct(t.alias("target"), F.col("episode_index"), F.when(t == "frame", F.col("frame_index").cast("double")).when(t == "interval", ms("start_s")).otherwise(none).alias("a"), F.when(t == "interval", ms("end_s")).when(t == "frame", ms("start_s")).otherwise(none).alias("b"))


def upsert_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` replaces the labels of the same identity."""
    return delete_labels(labels, new).unionByName(new)


def delete_labels(labels: DataFrame, gone: DataFrame) -> DataFrame:
    probe = gone.select(F.to_json(label_identity()).alias("__id")).distinct()
    return labels.withColumn("__id", F.to_json(label_identity())).join(probe, "__id", "left_anti").drop("__id")


def label_violations(labels: DataFrame) -> DataFrame:
    """Labels that break a rule, with the rule's name."""
    t = F.coalesce("target", F.lit("episode"))
    rule = (
        F.when(~t.isin("episode", "interval", "frame"), "target")
        .when(F.col("episode_index").isNull(), "episode_index")
        .when(~F.col("quality_score").between(1, 5), "quality_score")
        .when((t == "interval") & (F.col("start_s").isNull() | F.col("end_s").isNull()), "interval_bounds")
        .when((t == "frame") & F.col("frame_index").isNull() & F.col("start_s").isNull(), "frame_position")
    )
    return labels.withColumn("rule", rule).where("rule is not null")


def tag_counts(labels: DataFrame, tags: str = "tags", top: int = 5) -> DataFrame:
    """The most frequent tags: by count, then by name."""
    return labels.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag").limit(top)


def cumulative_index(episodes: DataFrame, length: str = "length", key: str = "episode_index") -> DataFrame:
    """from_index and to_index of each episode in a dataset of consecutive frames."""
    w = Window.orderBy(key)
    return episodes.withColumn("to_index", F.sum(length).over(w)).withColumn("from_index", F.col("to_index") - F.col(length))


def task_vocabulary(rows: DataFrame, task: str, order: list[str]) -> DataFrame:
    """(task, task_index) in the order in which tasks are first seen."""
    first = rows.groupBy(task).agg(F.min(F.struct(*order)).alias("__first"))
    return first.select(task, (F.row_number().over(Window.orderBy("__first")) - 1).cast("long").alias("task_index"))


def remap_tasks(rows: DataFrame, vocabulary: DataFrame, task: str, index: str = "task_index") -> DataFrame:
    """Rows with their task's index in the vocabulary; a task that is not in it keeps its index."""
    v = vocabulary.select(F.col(task), F.col(index).alias("__new"))
    return rows.join(v, task, "left").withColumn(index, F.coalesce("__new", index)).drop("__new")


def merge_frames(sources: DataFrame) -> DataFrame:
    """Frames of (source, episode_index, frame_index, ...) renumbered as one dataset: sources in order, episodes
    within them; only one row an episode is ordered as a whole."""
    e = sources.groupBy("source", "episode_index").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("source", "episode_index")
    e = e.withColumns({"new_episode": (F.row_number().over(w) - 1).cast("long"), "__from": F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    own = Window.partitionBy("source", "episode_index").orderBy("frame_index")
    return sources.join(e, ["source", "episode_index"]).withColumn("index", (F.col("__from") + F.row_number().over(own) - 1).cast("long")).drop("__n", "__from")


def preflight(sources: DataFrame, baseline: DataFrame) -> DataFrame:
    """(source, code) of everything that keeps a source from being merged with the one-row baseline."""
    b = baseline.select(*[F.col(c).alias(f"__b_{c}") for c in CONFLICTS.values()])
    d = sources.join(F.broadcast(b))  # one row
    close = lambda a, c: F.abs(a - c) <= F.greatest(1e-6 * F.greatest(F.abs(a), F.abs(c)), F.lit(1e-6))
    differs = lambda c: ~F.coalesce(close(F.col(c), F.col(f"__b_{c}")), F.col(c).eqNullSafe(F.col(f"__b_{c}"))) if c == "fps" else ~F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    codes = [F.when(F.col("n_episodes") <= 0, "empty_dataset"), F.when(F.col("n_schemas") > 1, "internal_schema"), *[F.when(differs(c), code) for code, c in CONFLICTS.items()]]
    return d.select("source", F.explode(F.filter(F.array(*codes), lambda c: c.isNotNull())).alias("code"))


def is_image_topic(topic: Column, schema: Column) -> Column:
    t, n = F.lower(topic), F.lower(F.coalesce(schema, F.lit("")))
    plain = t.contains("compressed") & F.exists(F.array(*[F.lit(w) for w in IMAGE_WORDS]), lambda w: t.contains(w))
    return F.when(t.contains("camera_info") | n.contains("calibration"), False).otherwise(n.contains("compressedimage") | n.endswith(".image") | n.endswith("rawimage") | plain)


def is_joint_topic(topic: Column, schema: Column) -> Column:
    t, n = F.lower(topic), F.lower(F.coalesce(schema, F.lit("")))
    out = t.contains("pose") | n.contains("poseinframe") | n.contains("jointstate") | n.contains("float64multiarray")
    for word in JOINT_WORDS:
        out = out | t.contains(word)
    return out


def anchor_topics(summary: DataFrame) -> DataFrame:
    """(file, topic) of the topic that a log's episodes are split by: the joint topic with most messages, else the image
    topic, else any; ties go to the smaller name. ``summary``: file, topic, schema_name, messages."""
    t, n = F.col("topic"), F.col("schema_name")
    rank = F.when(is_joint_topic(t, n), 0).when(is_image_topic(t, n), 1).otherwise(2)
    return summary.groupBy("file").agg(F.min_by("topic", F.struct(rank.alias("r"), (-F.col("messages")).alias("n"), "topic")).alias("topic"))
