"""Adapters of dataset formats by their id: what reads, writes and inspects each."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession

from epiframe.sources import episodes as E
from epiframe.sources import log_episodes as L


class Adapter(ABC):
    """A format: episodes and frames of a dataset as DataFrames, and a writer where it has one."""

    format_id: str

    @abstractmethod
    def episodes(self, spark: SparkSession, path: str) -> DataFrame: ...

    @abstractmethod
    def frames(self, spark: SparkSession, path: str, episode_indices: list[int] | None = None, keys: list[str] | None = None) -> DataFrame: ...

    def write(self, frames: DataFrame, path: str, fps: float, **how) -> None:
        raise NotImplementedError(f"{self.format_id} has no writer")


class ParquetAdapter(Adapter):
    def __init__(self, format_id: str):
        self.format_id = format_id

    def episodes(self, spark, path):
        return E.episodes(spark, path)

    def frames(self, spark, path, episode_indices=None, keys=None):
        return E.frames(spark, path, episode_indices, keys)

    def write(self, frames, path, fps, **how):
        E.WRITERS[self.format_id](frames, path, fps, **how)


class MessageLogAdapter(Adapter):
    """Episodes and series of message logs; writes nothing but copies of logs (``log_episodes.subset`` and ``merged``)."""

    format_id = E.MESSAGE_LOG

    def episodes(self, spark, path):
        return L.episodes(spark, path)

    def frames(self, spark, path, episode_indices=None, keys=None):
        return L.series(spark, path, episode_indices, keys)


class MissingAdapter(Adapter):
    """A format whose library may not be there; every use names it."""

    def __init__(self, format_id: str, library: str):
        self.format_id, self.library = format_id, library

    def episodes(self, spark, path):
        raise ModuleNotFoundError(f"{self.format_id} needs the library {self.library}", name=self.library)

    def frames(self, spark, path, episode_indices=None, keys=None):
        return self.episodes(spark, path)


_ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    _ADAPTERS[adapter.format_id] = adapter


def adapter_of(spark: SparkSession, path: str, format_id: str | None = None) -> Adapter:
    """The adapter of a format, or of the one that the path is found to have."""
    kind = format_id or E.detect_format(spark, path)
    if kind not in _ADAPTERS:
        raise ValueError(f"{path}: no adapter for format {kind}")
    return _ADAPTERS[kind]


for _a in (ParquetAdapter(E.V2), ParquetAdapter(E.V3), MessageLogAdapter(), MissingAdapter(E.HDF5, "h5py")):
    register(_a)
