"""Streams of telemetry: bounded histories, last values and topic rates.

These run on Structured Streaming; late rows, watermarks and exactly-once sinks are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY = "key string, n int, first_ns long, last_ns long, last_value double"


def bounds(seconds: float = 20, points: int = 2000) -> tuple[float, int]:
    """History limits within 5 to 120 s and 100 to 10,000 points."""
    return min(120.0, max(5.0, seconds)), min(10_000, max(100, points))


def prune(times: list[int], values: list[float], seconds: float, points: int) -> tuple[list[int], list[float]]:
    """What stays of a history: points of the last ``seconds``, the newest ``points`` of them at most, in order of
    time."""
    order = sorted(range(len(times)), key=lambda i: times[i])
    cutoff = times[order[-1]] - int(seconds * 1e9) if order else 0
    kept = [i for i in order if times[i] >= cutoff][-points:]
    return [times[i] for i in kept], [values[i] for i in kept]


def bounded_history(stream: DataFrame, seconds: float = 20, points: int = 2000) -> DataFrame:
    """(key, t_ns, value) rows to the state of each key's history after every batch, kept within the bounds."""
    seconds, points = bounds(seconds, points)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        times, values = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        for b in batches:
            times, values = prune(times + b.t_ns.tolist(), values + b.value.tolist(), seconds, points)
        state.update((times, values))
        yield pd.DataFrame({"key": [key[0]], "n": [len(times)], "first_ns": [times[0]], "last_ns": [times[-1]], "last_value": [values[-1]]})

    return stream.groupBy("key").applyInPandasWithState(step, HISTORY, "times array<long>, values array<double>", "update", "NoTimeout")


def last_values(stream: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The newest value of each key, as running state."""
    return stream.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def topic_rates(stream: DataFrame, at: str, topic: str, width: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Messages a second of each topic in tumbling windows, once the watermark has passed them."""
    seconds = F.col("w.end").cast("timestamp").cast("double") - F.col("w.start").cast("timestamp").cast("double")
    d = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), topic).agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").alias("start"), topic, "n", (F.col("n") / seconds).alias("hz"))


def fresh(last: DataFrame, keys: list[str], at: str, now: float, max_age: float) -> DataFrame:
    """Whether every key's last time, in seconds, is within ``max_age`` of ``now``, before or after."""
    return last.groupBy(*keys).agg(F.min(F.abs(F.lit(now) - F.col(at)) <= max_age).alias("fresh"))
