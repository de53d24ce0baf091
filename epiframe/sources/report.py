"""Quality reports as Parquet tables under one folder, one partition a scan; reviews and the audit log only grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.operators.quality import latest

TABLES = ("episodes", "findings", "episode_detectors")


def write_table(df: DataFrame, report: str, name: str, scan_id: str) -> None:
    """Replaces a scan's rows of a table; other scans' stay."""
    d = df.withColumn("scan_id", F.lit(scan_id))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(f"{report}/{name}")


def read_table(spark: SparkSession, report: str, name: str, scan_id: str | None = None, schema: str | None = None) -> DataFrame:
    """A table's rows, of one scan or all; with a schema, tables that no scan has rows of can be read too."""
    reader = spark.read.schema(f"{schema}, scan_id string") if schema else spark.read
    d = reader.parquet(f"{report}/{name}").withColumn("scan_id", F.col("scan_id").cast("string"))
    return d if scan_id is None else d.where(F.col("scan_id") == scan_id)


def add_reviews(reviews: DataFrame, report: str) -> None:
    """Appends (finding_id, review_status, reviewed_at, ...) rows and notes each in the audit log."""
    reviews.write.mode("append").parquet(f"{report}/finding_reviews")
    reviews.select(F.lit("review_finding").alias("action"), F.col("finding_id").alias("target"), F.col("review_status").alias("detail"), F.col("reviewed_at").alias("at")).write.mode("append").parquet(f"{report}/audit_log")


def current_reviews(spark: SparkSession, report: str) -> DataFrame:
    """The latest review of each finding."""
    return latest(spark.read.parquet(f"{report}/finding_reviews"), ["finding_id"], "reviewed_at", "review_status").drop("rank")


def export_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order, as CSV part files with a header each; ranges keep the order across parts."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).csv(path)


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").json(path)


def missing_previews(previews: DataFrame, jobs: DataFrame) -> DataFrame:
    """Previews that no job refers to."""
    return previews.join(jobs, "preview_id", "left_anti")


def preview_gate(requests: DataFrame, previews: DataFrame) -> DataFrame:
    """Batch requests whose preview is completed and has the request's fingerprint."""
    done = previews.where("status = 'completed'").select("preview_id", "fingerprint")
    return requests.join(done, ["preview_id", "fingerprint"], "left_semi")
