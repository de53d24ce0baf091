"""What lies around datasets: census of folders, jobs, review progress, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.sources.episodes import Store

JOB = "id string, kind string, status string, created_at string, updated_at string, progress double, total long, error string"


def census(spark: SparkSession, path: str) -> DataFrame:
    """(folder, suffix, files, bytes) of all files below a path, from the file listing alone."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    folder, name = F.regexp_replace("path", r"/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    return f.groupBy(folder.alias("folder"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("suffix")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def jobs(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """Jobs, one JSON file each, newest first."""
    d = spark.read.schema(JOB).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)
    return d.orderBy(F.desc("created_at"), "id").limit(limit)


def eta(job_rows: DataFrame) -> DataFrame:
    """Adds ``eta_s``: the time that the rest takes at the pace so far."""
    spent = F.to_timestamp("updated_at").cast("double") - F.to_timestamp("created_at").cast("double")
    return job_rows.withColumn("eta_s", F.try_divide(spent * (F.col("total") - F.col("progress")), F.col("progress")))


def save_progress(spark: SparkSession, folder: str, states: dict[int, str], reasons: dict[int, str], dataset: str, at: str, by: str = "") -> None:
    """Decisions of a review, published by renaming."""
    s, name = Store(spark, folder), "review_progress.json"
    body = {"version": 3, "dataset": dataset, "updatedAt": at, "updatedBy": by, "states": {str(k): v for k, v in states.items()}, "quarantineReasons": {str(k): v for k, v in reasons.items()}}
    s.write_text(f".{name}", json.dumps(body))
    s.delete(name)
    s.move(f"{folder}/.{name}", name)


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    """(episode_index, decision, reason)."""
    d = spark.read.schema("states map<string,string>, quarantineReasons map<string,string>").option("multiLine", "true").json(f"{folder}/review_progress.json")
    return d.select(F.explode("states").alias("k", "decision"), "quarantineReasons").select(F.col("k").cast("long").alias("episode_index"), "decision", F.try_element_at("quarantineReasons", "k").alias("reason"))
