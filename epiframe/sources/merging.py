"""Datasets of one format merged into a new one, published at once: frames under new numbers, episode rows, tasks,
statistics and sketches under the episodes' new numbers and those of the whole merged from them, labels, and a manifest.

Numbers come from the sources' episode rows (one row an episode is ordered as a whole); frames are read once, to be
written. Statistics are never taken from frames that have some in their dataset's metadata.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.functions.kernels import canonical_json, config_hash
from epiframe.operators import datasets as D
from epiframe.operators import stats as ST
from epiframe.operators.tables import rekey_stats
from epiframe.sources import episodes as E
from epiframe.sources import log_episodes as L
from epiframe.sources import registry
from epiframe.sources import sketches as K

#: Metadata that is written anew; the first source's other files beside them are copied.
OWN = {"info.json", "stats.json", "episodes", "episodes.jsonl", "episodes_stats.jsonl", "tasks", "tasks.jsonl", "tasks.parquet", "labels.jsonl", "export_manifest.json", K.NAME}
LABELS = ("labels.jsonl", "meta/labels.jsonl")


def file_signatures(spark: SparkSession, files: list[str], together: int = 64) -> list[str]:
    """The different schemas of Parquet files, as digests of names and types; footers are read by a job."""
    rows = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files) // together))

    def read(batches):
        import pyarrow.parquet as pq

        from epiframe.sources.message_log import _system

        for b in batches:
            out = []
            for f in b.column(0).to_pylist():
                system, own = _system(f)
                out.append(config_hash(sorted((x.name, str(x.type)) for x in pq.read_schema(own, filesystem=system)), 24))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["sig"])

    return [r.sig for r in rows.mapInArrow(read, "sig string").distinct().orderBy("sig").collect()]  # schemas, not files


def described(spark: SparkSession, path: str) -> dict:
    """What has to agree between datasets that are to be merged, and totals."""
    kind = E.detect_format(spark, path)
    e = registry.adapter_of(spark, path).episodes(spark, path)
    n, frames = e.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if kind == E.MESSAGE_LOG:
        topics = L.summary(spark, path).select("topic", "schema_name", "image").distinct().orderBy("topic", "schema_name").collect()  # rows of topics
        features, cameras, signatures = [[r.topic, r.schema_name] for r in topics], sorted({r.topic for r in topics if r.image}), []
        fps, robot = L.frame_rate(e), None
    else:
        info = E.read_info(spark, path)
        features = info.get("features") or {}
        cameras = sorted(k for k, f in features.items() if f.get("dtype") in ("video", "image"))
        fps, robot = float(info.get("fps") or 0), info.get("robot_type")
        s = E.Store(spark, path)
        signatures = file_signatures(spark, s.files("data/chunk-*/*.parquet"))
    return {"path": path, "format_id": kind, "fps": fps, "robot_type": robot, "cameras": canonical_json(cameras), "features": canonical_json(features), "dialect": None, "schema_sig": ",".join(signatures), "n_schemas": len(signatures), "n_episodes": n, "n_frames": frames}


def preflight(spark: SparkSession, paths: list[str]) -> tuple[list[dict], list[tuple[int, str]]]:
    """The sources' descriptions, and (source, code) of what keeps them from being merged."""
    if len(paths) < 2 or len({p.rstrip("/") for p in paths}) != len(paths):
        raise ValueError("a merge needs two or more different datasets")
    told = [described(spark, p) for p in paths]
    kinds = "source int, path string, format_id string, fps double, robot_type string, cameras string, features string, dialect string, schema_sig string, n_schemas int, n_episodes long, n_frames long"
    rows = spark.createDataFrame([(i, *t.values()) for i, t in enumerate(told)], kinds)
    return told, sorted((r.source, r.code) for r in D.preflight(rows, rows.where("source = 0")).collect())  # a few rows a source


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_source(parts: list[DataFrame]) -> DataFrame:
    return union([p.withColumn("source", F.lit(i)) for i, p in enumerate(parts)])


def vocabulary(spark: SparkSession, paths: list[str], episode_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(task, task_index) in order of first use by episodes of each source and then in its task table, and (source,
    task_index, new_task)."""
    def has(p):
        s = E.Store(spark, p)
        return s.has("meta/tasks.jsonl") or s.has("meta/tasks.parquet")

    none = spark.createDataFrame([], "task_index long, task string")
    own = with_source([E.tasks_table(spark, p) if has(p) else none for p in paths]).where("task <> ''")
    used = episode_rows.select("source", F.lit(0).alias("kind"), "episode_index", F.posexplode("tasks").alias("at", "task")).where("task <> ''")
    every = used.unionByName(own.select("source", F.lit(1).alias("kind"), F.col("task_index").alias("episode_index"), F.lit(0).alias("at"), "task"))
    named = D.task_vocabulary(every, "task", ["source", "kind", "episode_index", "at"])
    return named, own.join(named.withColumnRenamed("task_index", "new_task"), "task").select("source", "task_index", "new_task")


def overall(stats: DataFrame, sketches: DataFrame | None = None) -> dict:
    """Statistics of the whole by series, one list a metric; merged from those of episodes. Quantiles are those of the
    merged sketches wherever these have seen as many values as the statistics tell of."""
    arrays = {f.name for f in stats.schema.fields if f.dataType.simpleString() == "array<double>"}
    parts = []
    for series in sorted({c[len("stats/") :].rsplit("/", 1)[0] for c in arrays}):
        have = {m for m in ("min", "max", "mean", "std", "count", *ST.QUANTILES) if f"stats/{series}/{m}" in arrays}
        if not {"min", "max", "mean", "std", "count"} <= have:
            continue
        dims = stats.select("*", F.posexplode(F.col(f"`stats/{series}/mean`")).alias("dim", "__v"))
        at = lambda m, series=series: F.coalesce(F.get(F.col(f"`stats/{series}/{m}`"), F.col("dim")), F.get(F.col(f"`stats/{series}/{m}`"), F.lit(0)))
        parts.append(dims.select(F.lit(series).alias("series"), "dim", *[at(m).alias(m) for m in sorted(have)]))
    if not parts:
        return {}
    merged = ST.merge_stats(union(parts), ["series", "dim"])
    if sketches is not None:
        of = ST.merge_sketches(sketches, ["series", "dim"]).select("series", "dim", F.col("count").alias("__n"), F.struct(*ST.QUANTILES).alias("__q"))
        estimate = lambda q: F.col(q) if q in merged.columns else F.lit(None).cast("double")
        whole = F.col("__n") == F.col("count")
        merged = merged.join(of, ["series", "dim"], "left").withColumns({q: F.when(whole, F.col(f"__q.{q}")).otherwise(estimate(q)) for q in ST.QUANTILES}).drop("__n", "__q")
    rows = merged.orderBy("series", "dim").collect()  # one a series and dimension
    out: dict = {}
    for r in rows:
        for k, v in r.asDict().items():
            if k not in ("series", "dim"):
                out.setdefault(r.series, {}).setdefault(k, []).append(v)
    return out


def merged_labels(spark: SparkSession, paths: list[str], mapping: DataFrame) -> DataFrame | None:
    """The sources' labels under the episodes' new numbers."""
    found = [(i, next((n for n in LABELS if E.Store(spark, p).has(n)), None)) for i, p in enumerate(paths)]
    parts = [E.read_labels(spark, f"{paths[i]}/{n}").where("episode_index is not null").withColumn("source", F.lit(i)) for i, n in found if n]
    return rekey_stats(union(parts), mapping).drop("source") if parts else None


def merge(spark: SparkSession, paths: list[str], target: str, labels: bool = True) -> dict:
    """Merges datasets of one format; returns the manifest. Datasets that do not agree are an error, as are a target that
    exists or lies within a source, and frames that are not those that the episode rows tell of."""
    for p in paths:
        if (target.rstrip("/") + "/").startswith(p.rstrip("/") + "/"):
            raise ValueError(f"{target} lies within {p}")
    told, conflicts = preflight(spark, paths)
    if conflicts:
        raise ValueError("datasets differ: " + ", ".join(f"{paths[i]} {code}" for i, code in conflicts))
    kind = told[0]["format_id"]
    e = with_source([registry.adapter_of(spark, p).episodes(spark, p).select("episode_index", "length", "tasks") for p in paths])
    placed = D.cumulative_index(e.withColumn("place", F.struct("source", "episode_index")), key="place")
    number = (F.row_number().over(Window.orderBy("place")) - 1).cast("long")
    mapping = placed.withColumns({"new_episode": number, "source_dataset": F.lit(paths)[F.col("source")]}).drop("place")
    manifest = {"version": 1, "format": kind, "sources": [{"path": t["path"], "total_episodes": t["n_episodes"], "total_frames": t["n_frames"]} for t in told], "total_episodes": sum(t["n_episodes"] for t in told), "total_frames": sum(t["n_frames"] for t in told)}
    pairs = mapping.select(F.col("new_episode").alias("output_episode_index"), "source_dataset", F.col("episode_index").alias("source_episode_index")).orderBy("output_episode_index")
    moved = merged_labels(spark, paths, mapping) if labels and kind != E.MESSAGE_LOG else None
    manifest["labels_merged"] = moved.count() if moved is not None else 0

    if kind == E.MESSAGE_LOG:
        manifest["messages"] = sum(r.messages for r in L.merged(spark, paths, target).select("messages").collect())  # one row a log
        beside = E.Store(spark, target.rstrip("/").rsplit("/", 1)[0])
        name = target.rstrip("/").rsplit("/", 1)[1]
        E._write_lines(pairs, beside, f"{name}.merge_mapping.jsonl")
        beside.write_text(f"{name}.merge_manifest.json", json.dumps(manifest, indent=2))
        return manifest

    def fill(s: E.Store) -> None:
        named, renumbered = vocabulary(spark, paths, e)
        raw = with_source([spark.read.option("recursiveFileLookup", "true").parquet(f"{p}/data") for p in paths])
        d = raw.join(mapping.select("source", "episode_index", "new_episode", "from_index"), ["source", "episode_index"])
        series = [c for c in raw.columns if c not in ("source", "episode_index", "index", "task_index")]
        if "task_index" in raw.columns:
            d = d.join(renumbered, ["source", "task_index"], "left").withColumn("task_index", F.coalesce("new_task", "task_index"))
            series.append("task_index")
        d = d.select((F.col("from_index") + F.col("frame_index")).cast("long").alias("index"), F.col("new_episode").alias("episode_index"), *[F.col(f"`{c}`") for c in series])
        rows = mapping.select(F.col("new_episode").alias("episode_index"), "length", "from_index", "to_index", "tasks")
        of = [E.episode_stats(spark, p) for p in paths]
        of = [x if x is not None else E._with_stats(raw.where(F.col("source") == i).select("episode_index").distinct(), raw.where(F.col("source") == i)) for i, x in enumerate(of)]
        flat = [x.select("episode_index", *[F.col(f"`{c}`").cast("array<double>").alias(c) if dict(x.dtypes)[c] in ("array<bigint>", "array<float>", "array<int>") else F.col(f"`{c}`") for c in x.columns[1:]]) for x in of]
        stats = rekey_stats(with_source(flat), mapping).drop("source", "new_episode")
        info = E.read_info(spark, paths[0]) | {"total_episodes": manifest["total_episodes"], "total_frames": manifest["total_frames"], "total_tasks": named.count(), "splits": {"train": f"0:{manifest['total_episodes']}"}, "data_path": E.PATHS[kind]}
        {E.V2: E.fill_v2, E.V3: E.fill_v3}[kind](s, d, rows, named, info, stats)
        have = spark.read.option("recursiveFileLookup", "true").parquet(f"{s.path.toString()}/data").agg(F.count(F.lit(1)), F.count_distinct("index")).first()
        if tuple(have) != (manifest["total_frames"],) * 2:
            raise ValueError(f"{have[0]} frames and {have[1]} numbers for {manifest['total_frames']}")
        seen = [K.read(spark, p) for p in paths]
        if all(x is not None for x in seen):
            K.write(with_source(seen).join(mapping.select("source", "episode_index", "new_episode"), ["source", "episode_index"]).drop("source", "episode_index").withColumnRenamed("new_episode", "episode_index"), s)
        s.write_text("meta/stats.json", json.dumps(overall(stats, K.read(spark, s.path.toString())), indent=2))
        base = E.Store(spark, paths[0])
        for f in base.files("meta/*"):
            if (name := f.rstrip("/").rsplit("/", 1)[1]) not in OWN:
                s.jvm.org.apache.hadoop.fs.FileUtil.copy(base.fs, s.jvm.org.apache.hadoop.fs.Path(f), s.fs, s.sub(f"meta/{name}"), False, spark.sparkContext._jsc.hadoopConfiguration())
        if moved is not None:
            E._write_lines(moved.orderBy("episode_index"), s, "labels.jsonl")
        E._write_lines(pairs, s, "merge_mapping.jsonl")
        s.write_text("merge_manifest.json", json.dumps(manifest, indent=2))

    E._published(spark, target, fill)
    return manifest
