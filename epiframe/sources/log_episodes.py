"""Message logs as episodes: one a file where there are several, else split at gaps of an anchor topic.

Gaps are found without sorting messages. Two messages in one bucket of the gap's width are never further apart than
the gap, and with an empty bucket between them always are; so one aggregation leaves first, last and count of each
bucket, a row for two seconds of recording, and only such rows are compared with the one before. Messages find their
episode by an equi-join on slices of time with the window as a residual, so the messages of one long file are spread
over its slices.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.operators.datasets import anchor_topics, is_image_topic, is_joint_topic
from epiframe.sources import log_copy
from epiframe.sources.message_log import MessageLogSource, MessageLogSummarySource, log_files

GAP_S = 2.0
#: Slices of the whole time that windows are dealt to, at the least; an episode is in one or a few.
SLICES = 4096


def gap_episodes(rows: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """(keys, segment, start, end, length): runs of whole-number times of which none is more than ``gap`` after the one
    before; ``segment`` counts from 0 by time."""
    bucket = F.expr(f"(`{t}` - pmod(`{t}`, {max(int(gap), 1)}L)) div {max(int(gap), 1)}L")
    buckets = rows.where(F.col(t).isNotNull()).groupBy(*keys, bucket.alias("__b"))
    buckets = buckets.agg(F.min(t).alias("__first"), F.max(t).alias("__last"), F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__b")
    opened = F.coalesce((F.col("__first") - F.lag("__last").over(w) > gap).cast("int"), F.lit(0))
    d = buckets.withColumn("__o", opened).withColumn("segment", F.sum("__o").over(w).cast("long"))
    return d.groupBy(*keys, "segment").agg(F.min("__first").alias("start"), F.max("__last").alias("end"), F.sum("__n").alias("length"))


def in_windows(rows: DataFrame, windows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Rows with the columns of every window (keys, start, end, ...) of their keys that holds their time, both ends
    included; rows in none go."""
    low, high = windows.agg(F.min("start"), F.max("end")).first()
    width = max(1, (0 if low is None else high - low) // SLICES)
    cut = lambda c: F.expr(f"({c} - pmod({c}, {width}L)) div {width}L")
    w = windows.withColumnsRenamed({k: f"__{k}" for k in keys}).withColumn("__s", F.explode(F.sequence(cut("start"), cut("end"))))
    own = rows.withColumn("__t", cut(t))
    met = own.join(w, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__t") == F.col("__s"), F.col(t).between(F.col("start"), F.col("end"))])
    return met.drop("__t", "__s", *[f"__{k}" for k in keys])


def topic_key(topic):
    return F.regexp_replace(F.regexp_replace(topic, "^/+|/+$", ""), "/", "_")


def task_name(path: str) -> str:
    """The nearest folder's name that is no number; shards are numbered."""
    folder = os.path.dirname(path) if path.endswith(".mcap") else path.rstrip("/")
    names = [n for n in folder.split("/") if n][-2:]
    return next((n for n in reversed(names) if not n.isdigit()), names[-1] if names else "")


def summary(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """Topics of each file with their kind, from the footers; with ``errors`` files that cannot be read have none."""
    spark.dataSource.register(MessageLogSummarySource)
    t, n = F.col("topic"), F.col("schema_name")
    return spark.read.format("message_log_summary").options(**({"errors": "rows"} if errors else {})).load(path).withColumns({"image": is_image_topic(t, n), "joint": is_joint_topic(t, n)})


def messages(spark: SparkSession, path: str, topics: list[str] | None = None, since: int | None = None, until: int | None = None, errors: bool = False) -> DataFrame:
    spark.dataSource.register(MessageLogSource)
    told = {"topics": ",".join(topics) if topics else None, "since": since, "until": until, "errors": "rows" if errors else None}
    return spark.read.format("message_log").options(**{k: v for k, v in told.items() if v is not None}).load(path)


def episodes(spark: SparkSession, path: str, gap_s: float = GAP_S, errors: bool = False) -> DataFrame:
    """(episode_index, length, duration, tasks, cameras, file, start, end). Of several files each is an episode: its
    length is the most messages of an image topic, or where it has none all messages. A single file is split at gaps of
    its anchor topic, whose messages make the length; a file without messages is one episode of length 0. With
    ``errors`` so is a file that cannot be read, and chunks that cannot be count for nothing."""
    files = log_files(path)
    if not files:
        raise ValueError(f"{path} has no message logs")
    topics = summary(spark, path, errors)
    cameras = F.array_sort(F.collect_set(F.when(F.col("image"), topic_key(F.col("topic")))))
    own = topics.groupBy("file").agg(F.max(F.when(F.col("image"), F.col("messages"))).alias("images"), F.sum("messages").alias("all"), F.min("start_time").alias("start"), F.max("end_time").alias("end"), cameras.alias("cameras"))
    at = spark.createDataFrame(list(enumerate(files)), "episode_index long, file string")
    numbers = at.join(own, "file", "left").withColumn("cameras", F.coalesce("cameras", F.array().cast("array<string>")))
    if len(files) > 1:
        e = numbers.withColumn("length", F.when(F.col("images") > 0, F.col("images")).otherwise(F.coalesce("all", F.lit(0))))
    else:
        anchor = anchor_topics(topics.where("messages > 0")).first()
        if anchor is None:
            e = numbers.withColumn("length", F.lit(0))
        else:
            parts = gap_episodes(messages(spark, path, [anchor.topic], errors=errors).where("error is null"), ["file"], "log_time", int(gap_s * 1e9))
            e = parts.join(numbers.select("file", "cameras"), "file").withColumn("episode_index", F.col("segment"))
    tasks = F.array(F.lit(task_name(path)))
    duration = F.coalesce(F.greatest(F.lit(0.0), (F.col("end") - F.col("start")) / 1e9), F.lit(0.0))
    return e.select("episode_index", F.col("length").cast("long").alias("length"), duration.alias("duration"), tasks.alias("tasks"), "cameras", "file", F.coalesce("start", F.lit(0)).cast("long").alias("start"), F.coalesce("end", F.lit(0)).cast("long").alias("end"))


def frame_rate(episode_rows: DataFrame) -> float:
    """Of several files the mean of their own rates; of one the anchor's messages over the time from first to last."""
    files, n, span, rates = episode_rows.agg(F.count_distinct("file"), F.sum("length"), (F.max("end") - F.min("start")) / 1e9, F.avg(F.when((F.col("duration") > 0) & (F.col("length") > 1), (F.col("length") - 1) / F.col("duration")))).first()
    return float(rates or 0.0) if files != 1 else (n - 1) / span if n > 1 and span > 0 else 0.0


def labelled(spark: SparkSession, path: str, episode_rows: DataFrame, topics: list[str] | None = None, errors: bool = False) -> DataFrame:
    """Messages of the episodes, with their ``episode_index``; what lies outside of all windows is not decoded."""
    since, until = episode_rows.agg(F.min("start"), F.max("end")).first()
    windows = episode_rows.select("episode_index", "file", "start", "end")
    return in_windows(messages(spark, path, topics, since, until, errors).where("error is null"), windows, ["file"], "log_time").drop("start", "end", "error")


def failures(spark: SparkSession, path: str, episode_rows: DataFrame) -> DataFrame:
    """(episode_index, error) of what cannot be read: chunks by the episode that their first time lies in, else by the
    episode before it, and files."""
    bad = messages(spark, path, errors=True).where("error is not null").select("file", "log_time", "error")
    e = episode_rows.select("episode_index", "file", "start")
    first = e.groupBy("file").agg(F.min_by("episode_index", "start").alias("__first"))
    met = bad.join(e, "file").groupBy("file", "log_time", "error").agg(F.max_by("episode_index", F.when(F.col("start") <= F.col("log_time"), F.col("start"))).alias("episode_index"))
    return met.join(first, "file").select(F.coalesce("episode_index", "__first").alias("episode_index"), "error")


def series(spark: SparkSession, path: str, episode_indices: list[int] | None = None, keys: list[str] | None = None, errors: bool = False) -> DataFrame:
    """(episode_index, frame_index, <series>...): vectors of the joint topics by their order of time. Poses of all pose
    topics, side by side, are ``action``, up to the shortest; the first two are also ``eef.<topic>``. A topic of plain
    numbers is ``action`` where its name says so and that is free, else ``observation.state``, else by its name."""
    from epiframe.functions.payloads import decode_vector

    e = episodes(spark, path, errors=errors)
    e = e.where(F.col("episode_index").isin(episode_indices)) if episode_indices is not None else e
    pose = F.lower("topic").contains("pose") | F.lower(F.coalesce("schema_name", F.lit(""))).contains("poseinframe")
    joint = sorted(summary(spark, path, errors).where("joint").select("topic", pose.alias("pose")).distinct().collect())  # one row a topic
    if not joint:
        return e.select("episode_index").limit(0).withColumn("frame_index", F.lit(0).cast("long"))
    rows = labelled(spark, path, e, [r.topic for r in joint], errors)
    rows = rows.withColumn("value", decode_vector(F.col("data"), F.when(F.lower("topic").contains("pose"), "poseinframe").otherwise(F.col("schema_name")))).where("value is not null")
    order = Window.partitionBy("episode_index", "topic").orderBy("log_time", "sequence")
    rows = rows.select("episode_index", "topic", "value", (F.row_number().over(order) - 1).cast("long").alias("frame_index"))
    wide = rows.groupBy("episode_index", "frame_index").agg(*[F.max(F.when(F.col("topic") == r.topic, F.col("value"))).alias(r.topic) for r in joint])
    poses, named = [r.topic for r in joint if r.pose], {}
    if poses:
        arms = [F.col(f"`{t}`") for t in poses]
        named["action"] = F.when(F.forall(F.array(*arms), lambda a: a.isNotNull()), F.flatten(F.array(*arms)))
        named |= {"eef." + t.strip("/").replace("/", "_"): F.when(named["action"].isNotNull(), F.col(f"`{t}`")) for t in poses[:2]}
    for t in (r.topic for r in joint if not r.pose):
        name = "action" if "action" in t.lower() else "observation.state"
        named[t if name in named else name] = F.col(f"`{t}`")
    kept = {k: c for k, c in named.items() if keys is None or k in keys or k.startswith("eef.")}
    some = F.exists(F.array(*kept.values()), lambda c: c.isNotNull()) if kept else F.lit(False)
    return wide.where(some).select("episode_index", "frame_index", *[c.alias(k) for k, c in kept.items()])


def subset(spark: SparkSession, path: str, selected: list[int], target: str) -> DataFrame:
    """The messages of some episodes as logs: one file where the target's name is a log's, else a folder with one an
    episode. Chunks within a window are copied as they are. (target, messages, whole_chunks)."""
    kept = sorted({int(i) for i in selected})
    e = episodes(spark, path).where(F.col("episode_index").isin(kept))
    gone = set(kept) - {r.episode_index for r in e.select("episode_index").collect()}  # a stated selection
    if gone:
        raise ValueError(f"{path} has no episodes {sorted(gone)}")
    windows = e.select(F.format_string("episode_%06d.mcap", "episode_index").alias("target"), F.col("episode_index").alias("at"), "file", "start", "end", F.lit(None).cast("long").alias("shift"))
    return log_copy.publish(spark, windows, log_files(path), target)


def merged(spark: SparkSession, paths: list[str], target: str) -> DataFrame:
    """All episodes of several datasets, one after another in time with a pause between them, as one log or a folder of
    logs. (target, messages, whole_chunks)."""
    from epiframe.functions.kernels import retimed

    rows, files = [], []
    for i, p in enumerate(paths):
        rows.append(episodes(spark, p).withColumn("source", F.lit(i)))
        files += log_files(p)
    e = rows[0]
    for more in rows[1:]:
        e = e.unionByName(more)
    latest = None
    for i, p in enumerate(paths):  # published times may lie behind the window
        m = labelled(spark, p, rows[i])
        x = m.groupBy("episode_index").agg(F.max("publish_time").alias("published")).withColumn("source", F.lit(i))
        latest = x if latest is None else latest.unionByName(x)
    e = e.join(latest, ["source", "episode_index"], "left").withColumn("span", F.greatest(F.col("end") - F.col("start"), F.col("published") - F.col("start")))
    e = retimed(e.withColumn("place", F.struct("source", "episode_index")), "place", pause=log_copy.PAUSE_NS)
    at = F.row_number().over(Window.orderBy("place")) - 1  # one row an episode
    windows = e.select(F.format_string("episode_%06d.mcap", at.cast("long")).alias("target"), at.cast("long").alias("at"), "file", "start", "end", F.col("starts_at").cast("long").alias("shift"))
    return log_copy.publish(spark, windows, files, target)
