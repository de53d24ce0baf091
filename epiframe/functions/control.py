"""Column functions of the control and augmentation kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators.signals import clamp


def request_after(steps: Column, latency_ms: Column, rate_hz: Column, margin_ms: float = 30.0) -> Column:
    """After how many of ``steps`` actions the next chunk is asked for."""
    reserved = F.greatest(F.lit(1), F.ceil((F.greatest(F.lit(0.0), latency_ms) + margin_ms) * rate_hz / 1000))
    auto = F.when(latency_ms.isNotNull() & (rate_hz > 0), steps - reserved).otherwise(F.floor(steps * 0.6))
    return F.greatest(F.lit(1), F.least(steps - 1, auto)).cast("long")


def brightness_curve(src50: Column, src90: Column, dst50: Column, dst90: Column) -> tuple[Column, Column]:
    """(gain, gamma) that bring a camera's middle and bright luma to the targets."""
    norm = lambda c, low: F.greatest(low if isinstance(low, Column) else F.lit(low), F.least(F.lit(0.999), c / 255.0))
    flat = src90 - src50 < 8.0
    x50, y50 = norm(src50, 1e-3), norm(dst50, 1e-3)
    x90, y90 = F.least(F.lit(0.999), norm(src90, x50 + 1e-3)), F.least(F.lit(0.999), norm(dst90, y50 + 1e-3))
    gamma = clamp(F.log(y50 / y90) / F.log(x50 / x90), 0.72, 1.35)
    gain = clamp(y90 / F.pow(x90, gamma), 0.72, 1.38)
    return F.when(flat, clamp(dst50 / F.greatest(src50, F.lit(1.0)), 0.72, 1.38)).otherwise(gain), F.when(flat, 1.0).otherwise(gamma)


def limit_violations(rows: DataFrame, keys: list[str], order: str, value: str, low: float, high: float, step: float, tolerance: float = 0.0) -> DataFrame:
    """Rows out of [low, high] or further than ``step`` from the row before, each by more than the tolerance; the row
    before counts clamped."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = rows.withColumn("clamped", clamp(F.col(value), low, high)).withColumn("before", F.lag("clamped").over(w))
    kind = F.when((F.col(value) < low - tolerance) | (F.col(value) > high + tolerance), "limit").when(F.abs(F.col("clamped") - F.col("before")) > step + tolerance, "step")
    return d.withColumn("kind", kind).where("kind is not null").drop("clamped", "before")


def rolling(rows: DataFrame, keys: list[str], order: str, value: str, n: int = 200) -> DataFrame:
    """Mean and maximum of the last ``n`` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    return rows.withColumns({"rolling_mean": F.avg(value).over(w), "rolling_max": F.max(value).over(w)})


def failure_streaks(rows: DataFrame, keys: list[str], order: str, failed: str, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive failures, with their first row and length."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = rows.withColumn("__i", F.row_number().over(w)).where(failed)
    d = d.withColumn("__g", F.col("__i") - F.row_number().over(w))
    return d.groupBy(*keys, "__g").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).drop("__g")


def signature(*parts: Column, length: int = 24) -> Column:
    """The first characters of the SHA-256 of the parts joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)
