"""Rewrites of columns and tables, and orders without a window over a whole table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pick_series(df: DataFrame, explicit: str | None, fallbacks: tuple[str, ...]) -> str | None:
    """The column of a series: the explicit name if there is one, else the first fallback; names match exactly."""
    if explicit is not None:
        return explicit if explicit in df.columns else None
    return next((c for c in fallbacks if c in df.columns), None)


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column with other values of the same type; nothing changes where there is no such column."""
    return df.withColumn(name, value.cast(df.schema[name].dataType)) if name in df.columns else df


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order and types; those that are missing are null, others go."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def camel(name: str) -> str:
    return re.sub(r"_+([a-z0-9])", lambda m: m[1].upper(), name)


def to_camel(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: camel(c) for c in df.columns})


def kept_dims(names: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Positions of the names that hold an included word, where there are any, and no excluded one, in any case."""
    has = lambda n, words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.lower(n).contains(w))
    ok = lambda n: (has(n, include) if include else F.lit(True)) & (~has(n, exclude) if exclude else F.lit(True))
    at = F.transform(names, lambda n, i: F.when(ok(n), i))
    return F.filter(at, lambda i: i.isNotNull())


def camera_keys(*lists: Column) -> Column:
    """Sorted union of camera keys."""
    out = F.array().cast("array<string>")
    for c in lists:
        out = F.array_union(out, F.coalesce(c, F.array().cast("array<string>")))
    return F.array_sort(out)


def rekey_stats(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Statistics by (source, episode_index) under the episodes' new numbers; those of episodes that are gone go."""
    return stats.join(mapping.select("source", "episode_index", "new_episode"), ["source", "episode_index"]).drop("episode_index").withColumnRenamed("new_episode", "episode_index")


def remap_episodes(rows: DataFrame, mapping: DataFrame, key: str = "episode_index") -> DataFrame:
    """Rows of kept episodes, with their ``new_index``; others go."""
    return rows.join(mapping.select(key, "new_index"), key)


def numbered(df: DataFrame, group: Column, order: list[str], name: str = "place") -> DataFrame:
    """A number from 0 over a whole table in the order of (group, order). Groups, whose order must be that of the rows,
    are counted and number on from those before; only one row a group is ordered as a whole."""
    d = df.withColumn("__group", group)
    sizes = d.groupBy("__group").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select("__group", F.coalesce(F.sum("__n").over(Window.orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    own = Window.partitionBy("__group").orderBy(*order)
    return d.join(offsets, "__group").withColumn(name, (F.col("__from") + F.row_number().over(own) - 1).cast("long")).drop("__group", "__from")


def natural_order(df: DataFrame, name: str = "name") -> DataFrame:
    """``place`` by length of the name, then by the name; groups share all but the last three characters."""
    n = F.length(name)
    return numbered(df, F.struct(n.alias("n"), F.substring(F.col(name), F.lit(1), F.greatest(F.lit(0), n - 3)).alias("p")), [name])


def every_nth(frames: DataFrame, stride: int, order: str = "frame_index") -> DataFrame:
    return frames.where(F.col(order) % max(1, stride) == 0)


def head_frames(frames: DataFrame, n: int = 90, order: str = "frame_index") -> DataFrame:
    """The first frames of each episode, for a preview."""
    return frames.where(F.col(order) < n)


def sample_of(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows by a seeded digest of the key."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(n)


def finding_order(findings: DataFrame, key: str = "episode_index") -> DataFrame:
    """``place`` within the episode: by start (untimed ones first), then by severity's name from the last letter on."""
    w = Window.partitionBy(key).orderBy(F.coalesce("start_s", F.lit(-1.0)), F.desc("severity"), "finding_id", F.col("review_status").asc_nulls_first())
    return findings.withColumn("place", F.row_number().over(w).cast("long"))


def set_groups(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct member sets, comma-joined in order, with how many keys have each, and whether there is one only."""
    sets = rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(member)), ",").alias("members"))
    g = sets.groupBy("members").agg(F.count(F.lit(1)).alias("keys"))
    return g.join(F.broadcast(g.agg((F.count(F.lit(1)) == 1).alias("consistent"))))  # one row


def schema_signature(schema: T.StructType, ignore: tuple[str, ...] = ()) -> str:
    """A digest of names and types, in the order of names."""
    from epiframe.functions.kernels import config_hash

    return config_hash(sorted((f.name, f.dataType.simpleString()) for f in schema.fields if f.name not in ignore), 24)


def signatures(rows: DataFrame, key: str, *parts: Column) -> DataFrame:
    """Per key: how many different signatures of the parts there are, and whether they agree."""
    sig = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return rows.groupBy(key).agg(F.countDistinct(sig).alias("signatures"), (F.countDistinct(sig) == 1).alias("same"))


def missing_from(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have.select(key), key, "left_anti")


def totals(episodes: DataFrame) -> DataFrame:
    """Episodes, frames and the largest number of cameras."""
    return episodes.agg(F.count(F.lit(1)).alias("episodes"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames"), F.coalesce(F.max(F.size("cameras")), F.lit(0)).alias("max_cameras"))


def review_summary(episodes: DataFrame, decision: str = "decision") -> DataFrame:
    """Decisions and the share of reviewed episodes, in percent."""
    d, n = F.col(decision), F.count(F.lit(1))
    return episodes.agg(n.alias("episodes"), *[F.count_if(d == k).alias(f"n_{k}") for k in ("pass", "review", "quarantine")], F.round(F.try_divide(100.0 * F.count_if(d.isNotNull()), n), 3).alias("reviewed_percent"))


def display_range(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Lowest and highest finite value per key; a flat one is widened by 1e-9."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(value))
    g = rows.groupBy(*keys).agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return g.withColumn("high", F.greatest("high", F.col("low") + 1e-9))


def reclaimed(files: DataFrame, keys: list[str]) -> DataFrame:
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def synthetic_frames(spark: SparkSession, n: int, width: int, value: float = 0.0) -> DataFrame:
    """``n`` frames of a constant vector."""
    return spark.range(n).select(F.lit(0).cast("long").alias("episode_index"), F.col("id").alias("frame_index"), F.array_repeat(F.lit(float(value)), width).alias("action"))
