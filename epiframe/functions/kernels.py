"""Kernels of action checks, joints, observations, logs and configurations."""

from __future__ import annotations

import copy
import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.functions.control import limit_violations


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, is_finite), F.lit(False))


def chunk_faults(chunk: Column, horizon: int, width: int) -> Column:
    """The first fault of an action chunk (rows of a vector each), null where there is none: ``horizon``, ``width`` or
    ``non_finite``."""
    return (
        F.when(F.coalesce(F.size(chunk), F.lit(-1)) != horizon, "horizon")
        .when(F.exists(chunk, lambda r: F.coalesce(F.size(r), F.lit(-1)) != width), "width")
        .when(~F.forall(chunk, all_finite), "non_finite")
    )


def broadcast_tolerance(tolerance: Column, width: Column) -> Column:
    """One tolerance for all dimensions, or as many as there are; null for other lengths."""
    return F.when(F.size(tolerance) == width, tolerance).when(F.size(tolerance) == 1, F.array_repeat(tolerance[0], width))


def hold_chunk(baseline: Column, horizon: int) -> Column:
    """The baseline row, held over the horizon."""
    return F.array_repeat(baseline, horizon)


def strict_violations(rows: DataFrame, keys: list[str], order: str, value: str, low: float, high: float, step: float) -> DataFrame:
    """Rows beyond the limits or the step, without a tolerance."""
    return limit_violations(rows, keys, order, value, low, high, step, 0.0)


def rejections(rows: DataFrame, keys: list[str], kind: str = "reject_kind") -> DataFrame:
    """Per key: safety rejections, which are held, other rejections, which are errors, and accepted rows."""
    k = F.col(kind)
    return rows.groupBy(*keys).agg(F.count_if(k == "safety").alias("held"), F.count_if(k.isNotNull() & (k != "safety")).alias("errors"), F.count_if(k.isNull()).alias("accepted"))


def latency(*parts: str) -> Column:
    """The sum of a request's parts; an absent one takes no time."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(F.col(p), F.lit(0.0))
    return total


def reorder_joints(names: Column, values: Column, wanted: list[str]) -> Column:
    """Values in the wanted order of joints; a joint that is missing is null."""
    by_name = F.map_from_arrays(names, values)
    return F.transform(F.array(*[F.lit(w) for w in wanted]), lambda j: F.try_element_at(by_name, j))


def missing_joints(names: Column, wanted: list[str]) -> Column:
    return F.array_except(F.array(*[F.lit(w) for w in wanted]), names)


def map_observation(observation: Column, mapping: dict[str, str]) -> tuple[Column, Column]:
    """A map of observations under their models' keys (``mapping``: model's key to source), and the missing sources."""
    pairs = [F.struct(F.lit(k).alias("key"), F.try_element_at(observation, F.lit(v)).alias("value")) for k, v in mapping.items()]
    return F.map_from_entries(F.array(*pairs)), F.array_except(F.array(*[F.lit(v) for v in mapping.values()]), F.map_keys(observation))


def padded_names(names: Column, width: Column, prefix: str = "d") -> Column:
    """As many names as the vector is long: given ones first, then the prefix and the position."""
    more = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit(prefix), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    own = F.coalesce(names, F.array().cast("array<string>"))
    return F.slice(F.concat(own, F.slice(more, F.size(own) + 1, F.greatest(F.lit(0), width - F.size(own)))), F.lit(1), F.greatest(F.lit(0), width))


def to_rgb(data, height, width, channels, order):
    """Raw image bytes as bytes in RGB order; null where their number is not height x width x channels."""

    @F.pandas_udf("binary")
    def turn(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, order: pd.Series) -> pd.Series:
        def one(b, h, w, c, o):
            if b is None or len(b) != h * w * c or c < 3:
                return None
            x = np.frombuffer(b, np.uint8).reshape(h, w, c)[..., :3]
            return x[..., ["bgr".index(k) if (o or "rgb").lower().startswith("bgr") else "rgb".index(k) for k in "rgb"]].tobytes()

        return pd.Series([one(*r) for r in zip(data, h, w, c, order, strict=True)], dtype=object)

    return turn(data, height, width, channels, order)


def log_tail(events: DataFrame, keys: list[str], order: list[str], keep: int = 500) -> DataFrame:
    """The newest ``keep`` entries of each log."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def union_override(saved: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Saved and discovered entries as one list, in which the saved ones win; ``origin`` tells which."""
    return saved.withColumn("origin", F.lit("saved")).unionByName(found.dropDuplicates([key]).join(saved.select(key), key, "left_anti").withColumn("origin", F.lit("found")), allowMissingColumns=True)


def undefined_references(rows: DataFrame, reference: str, defined: DataFrame, key: str) -> DataFrame:
    """Distinct references to what is not defined."""
    return rows.select(F.col(reference).alias("missing")).where("missing is not null").distinct().join(defined.select(F.col(key).alias("missing")), "missing", "left_anti")


def is_fresh(at: Column, now: Column | int, most: int) -> Column:
    """Within ``most`` of now, before or after."""
    return F.abs((F.lit(now) if isinstance(now, int) else now) - at) <= most


def pose_errors(poses: DataFrame, targets: DataFrame, keys: list[str], tolerance: float, joint: str = "joint") -> DataFrame:
    """Per key: the largest error against the targets by joint, whether it is within the tolerance, and whether a joint
    has no target. Errors combine by joint before the shuffle."""
    met = poses.join(targets.select(joint, "target"), joint, "left")
    error = F.max(F.abs(F.col("value") - F.col("target")))
    return met.groupBy(*keys).agg(error.alias("error"), (error <= tolerance).alias("reached"), (F.count_if(F.col("target").isNull()) > 0).alias("missing"))


def payload_rejected(n: Column, length: Column) -> Column:
    """A payload whose length is further from the episode's than a tenth of it, or 2."""
    return F.abs(n - length) > F.greatest(F.lit(2).cast("long"), F.floor(length / 10))


def reason_faults(rows: DataFrame, name: str = "id") -> DataFrame:
    """(id, repeated, malformed) of review reasons."""
    g = rows.groupBy(F.col(name).alias("id")).agg((F.count(F.lit(1)) > 1).alias("repeated"))
    return g.withColumn("malformed", ~F.coalesce(F.col("id").rlike("^[A-Za-z][A-Za-z0-9_-]{0,63}$"), F.lit(False)))


def trailing(rows: DataFrame, keys: list[str], at: str, span: int) -> DataFrame:
    """Rows of each key within ``span`` of its newest one."""
    return rows.withColumn("__last", F.max(at).over(Window.partitionBy(*keys))).where(F.col("__last") - F.col(at) <= span).drop("__last")


def retimed(spans: DataFrame, order: str, span: str = "span", least: int = 1, pause: int = 3_000_000) -> DataFrame:
    """Where each recording starts in a merged log: after the spans of those before it and a pause after each. One row
    a recording is ordered as a whole."""
    step = F.greatest(F.col(span), F.lit(least)) + pause
    return spans.withColumn("starts_at", F.sum(step).over(Window.orderBy(order)) - step)


def expired(rows: DataFrame, age_days: Column, family: Column, days: dict[str, int], otherwise: int) -> DataFrame:
    """What is older than its family's days to live."""
    limit = F.lit(otherwise)
    for k, v in days.items():
        limit = F.when(family == k, v).otherwise(limit)
    return rows.where(age_days > limit)


def deep_merge(base: dict, over: dict) -> dict:
    """``base`` with what ``over`` sets; dictionaries on both sides merge key by key, other values are replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def without_keys(x, volatile: frozenset[str]):
    """A nested value without the keys that change from run to run."""
    if isinstance(x, dict):
        return {k: without_keys(v, volatile) for k, v in x.items() if k not in volatile}
    return [without_keys(v, volatile) for v in x] if isinstance(x, list) else x


def canonical_json(x) -> str:
    """Sorted, compact JSON, the same for equal values."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def config_hash(x, length: int = 16) -> str:
    return hashlib.sha256(canonical_json(x).encode()).hexdigest()[:length]
