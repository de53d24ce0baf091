"""Quantile sketches of a dataset's episodes, kept as ``meta/sketches`` beside its other metadata: (episode_index, series,
dim, count, sketch), one row for each dimension of a vector series in each episode.

They are made once from the frames; from then on quantiles of any selection of episodes, and of datasets that are merged
again and again, come from them with an error that is stated (``operators.stats.rank_error``) and does not grow with
the number of merges. A sketch of k = 200 takes up to some 5 KB, so episodes of fewer frames than k take as much room as
their values; that is why datasets only have sketches where they are asked for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.operators import stats as ST
from epiframe.sources import episodes as E

NAME = "sketches"


def make(frame_rows: DataFrame, k: int = ST.SKETCH_K) -> DataFrame:
    """The sketches of all vector series of frames; no rows for episodes without values."""
    keys = ["episode_index", "series", "dim"]
    if not E._vector_columns(frame_rows):
        return frame_rows.sparkSession.createDataFrame([], "episode_index long, series string, dim int, count long, sketch binary")
    return ST.value_sketches(E.long_vectors(frame_rows, ["episode_index"]), keys, "value", k).where("count > 0")


def write(sketches: DataFrame, s: E.Store) -> None:
    """Puts sketches into a dataset in place of those it has; a broken write leaves these as they are."""
    staging = f"meta/.{NAME}-{uuid.uuid4().hex}"
    try:
        sketches.select("episode_index", "series", "dim", "count", "sketch").write.option("compression", "zstd").parquet(s.sub(staging).toString())
        s.delete(f"meta/{NAME}")
        s.move(s.sub(staging).toString(), f"meta/{NAME}")
    finally:
        s.delete(staging)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """A dataset's sketches, or None."""
    return spark.read.parquet(f"{path}/meta/{NAME}") if E.Store(spark, path).has(f"meta/{NAME}") else None


def add(spark: SparkSession, path: str, k: int = ST.SKETCH_K) -> None:
    """Makes the sketches of a version-2 or version-3 dataset from its frames."""
    if E.detect_format(spark, path) not in (E.V2, E.V3):
        raise ValueError(f"{path} has no vector series in Parquet")
    write(make(spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data"), k), E.Store(spark, path))


def quantiles(spark: SparkSession, path: str, episode_indices: list[int] | None = None) -> DataFrame:
    """(series, dim, count, quantiles) of a dataset or of some of its episodes, without reading frames."""
    d = read(spark, path)
    if d is None:
        raise ValueError(f"{path} has no sketches")
    return ST.merge_sketches(d if episode_indices is None else d.where(F.col("episode_index").isin(episode_indices)), ["series", "dim"]).drop("sketch")
