"""Metrics of raw RGB frames, one row a frame: the boundary between pixels and SQL.

Input rows: episode_index, camera_key, frame_index, height, width, channels, pixels (uint8, row by row).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.operators.tables import numbered

METRICS = "episode_index long, camera_key string, frame_index long, mean_luma double, p10 double, p50 double, p90 double, dark double, bright double, blur double, thumb array<float>"
#: Luma up to which, and from which on, a pixel is clipped.
CLIPPED = (5.0, 250.0)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def laplacian_variance(gray: np.ndarray) -> float:
    if min(gray.shape) < 3:
        return 0.0
    c = gray[1:-1, 1:-1]
    return float((gray[:-2, 1:-1] + gray[2:, 1:-1] + gray[1:-1, :-2] + gray[1:-1, 2:] - 4 * c).var())


def thumbnail(gray: np.ndarray, width: int) -> np.ndarray:
    """Block means, ``width`` blocks across at most."""
    step = max(1, -(-gray.shape[1] // width))
    h, w = gray.shape[0] // step * step or gray.shape[0], gray.shape[1] // step * step or gray.shape[1]
    step_h, step_w = min(step, h), min(step, w)
    return gray[: h // step_h * step_h, : w // step_w * step_w].reshape(h // step_h, step_h, w // step_w, step_w).mean((1, 3))


def frame_metrics(frames: DataFrame, width: int = 32) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                gray = luma(np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["channels"]))
                q = np.percentile(gray, [10, 50, 90])
                out.append((r["episode_index"], r["camera_key"], r["frame_index"], float(gray.mean()), *map(float, q), float((gray <= CLIPPED[0]).mean()), float((gray >= CLIPPED[1]).mean()), laplacian_variance(gray), thumbnail(gray, width).astype(np.float32).ravel().tolist()))
            kinds = (pa.int64(), pa.string(), pa.int64(), *[pa.float64()] * 7, pa.list_(pa.float32()))
            names = [f.split()[0] for f in METRICS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], names=names)

    return frames.select("episode_index", "camera_key", "frame_index", "height", "width", "channels", "pixels").mapInArrow(work, METRICS)


def with_change(metrics: DataFrame) -> DataFrame:
    """Mean absolute change of the thumbnail from the camera's frame before, and the share of it that changed."""
    before = F.lag("thumb").over(Window.partitionBy("episode_index", "camera_key").orderBy("frame_index"))
    step = F.aggregate(F.zip_with("thumb", "__before", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda n, x: n + x) / F.size("thumb")
    changed = F.size(F.filter(F.zip_with("thumb", "__before", lambda a, b: F.abs(a - b)), lambda x: x > 0)) / F.size("thumb")
    seen = F.col("__before").isNotNull()
    return metrics.withColumn("__before", before).withColumns({"change": F.when(seen, step), "changed_ratio": F.when(seen, changed)}).drop("__before", "thumb")


def visual_flags(metrics: DataFrame, dark: float = 40.0, bright: float = 245.0, blur: float = 35.0, frozen: float = 0.75) -> DataFrame:
    """Per frame: dark, overexposed, blurred, and frozen (no change to speak of)."""
    return with_change(metrics).drop("dark", "bright").withColumns({"dark": F.col("mean_luma") < dark, "overexposed": F.col("mean_luma") > bright, "blurred": F.col("blur") < blur, "frozen": F.coalesce(F.col("change") <= frozen, F.lit(False))})


def image_folder(spark: SparkSession, path: str, camera: str, episode: int = 0) -> DataFrame:
    """Frames of a folder of pictures, in the order of their names, as rows for ``frame_metrics``; pictures that cannot be
    read are left out. Spark's image source decodes them."""
    d = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    @F.pandas_udf("binary")
    def to_rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        """Spark's images are grey, BGR or BGRA, row by row."""

        def one(b: bytes, n: int) -> bytes:
            x = np.frombuffer(b, np.uint8).reshape(-1, n)
            return np.repeat(x, 3, 1).tobytes() if n == 1 else np.hstack([x[:, 2::-1], x[:, 3:]]).tobytes()

        return pd.Series([one(b, n) for b, n in zip(data, channels, strict=True)], dtype=object)

    numbered_frames = numbered(d, F.regexp_replace("origin", "[^/]*$", ""), ["origin"], "frame_index")
    grey = F.col("nChannels") == 1
    return numbered_frames.select(F.lit(episode).cast("long").alias("episode_index"), F.lit(camera).alias("camera_key"), "frame_index", "height", "width", F.when(grey, 3).otherwise(F.col("nChannels")).alias("channels"), to_rgb(F.col("data"), F.col("nChannels")).alias("pixels"))
