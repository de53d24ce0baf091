"""Episode datasets on disk: format detection, readers and writers of both Parquet layouts, label files, export.

Version 2 keeps one Parquet file an episode (``data/chunk-000/episode_000000.parquet``), with episode rows,
statistics and tasks in ``meta/*.jsonl``; version 3 keeps shards (``data/chunk-000/file-000.parquet``) with episode rows
and statistics in ``meta/episodes/chunk-000/*.parquet``. Both have ``meta/info.json``. Reading goes through Spark's
file sources, so columns and episodes are pruned at the scan; selected episodes are looked up first, and only the files
that hold them are listed. Writers let Spark write part files into a folder beside the target, rename them, and rename
the whole at the end, so a broken write leaves no dataset. Paths may be of any store that Spark reads.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

V2, V3, MESSAGE_LOG, HDF5 = "episodes_v2", "episodes_v3", "message_log", "hdf5"
INDEX_COLUMNS = ("index", "episode_index", "frame_index", "timestamp", "task_index")


class Store:
    """File listing through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def sub(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def has(self, name: str) -> bool:
        return self.fs.exists(self.sub(name))

    def is_file(self) -> bool:
        return self.fs.exists(self.path) and self.fs.getFileStatus(self.path).isFile()

    def any(self, *globs: str) -> bool:
        for g in globs:
            found = self.fs.globStatus(self.sub(g))
            if found is not None and len(found):
                return True
        return False

    def files(self, pattern: str) -> list[str]:
        """Paths below this one that match, in order."""
        return sorted(f.getPath().toString() for f in self.fs.globStatus(self.sub(pattern)) or [])

    def move(self, source: str, to: str) -> None:
        target = self.sub(to)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self.jvm.org.apache.hadoop.fs.Path(source), target):
            raise OSError(f"could not rename {source} to {to}")

    def write_text(self, name: str, text: str) -> None:
        out = self.fs.create(self.sub(name), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.sub(name), True)


def read_info(spark: SparkSession, path: str) -> dict:
    text = "\n".join(r.value for r in spark.read.text(f"{path}/meta/info.json").collect())  # one small file
    return json.loads(text)


#: Names of single files, versions in info.json, and files that tell a layout, each with its format, in
#: order of precedence.
SUFFIXES = {".hdf5": HDF5, ".h5": HDF5, ".mcap": MESSAGE_LOG}
VERSIONS = {"v3.0": V3, "v3": V3, "v2.1": V2, "v2.0": V2}
LAYOUTS = (("meta/episodes", V3), ("meta/episodes.jsonl", V2))
CENSUS = tuple((f"{depth}*{suffix}", kind) for suffix, kind in SUFFIXES.items() for depth in ("", "*/"))


def detect_format(spark: SparkSession, path: str) -> str | None:
    """A file's format by its suffix; a folder's by the version or else the layout it declares, and where it has no
    info.json or a foreign one, by the files there are. A broken info.json is no dataset."""
    s = Store(spark, path)
    if s.is_file():
        return next((kind for suffix, kind in SUFFIXES.items() if path.lower().endswith(suffix)), None)
    declared = None
    if s.has("meta/info.json"):
        try:
            version = str(read_info(spark, path).get("codebase_version", ""))
        except ValueError:
            return None
        declared = VERSIONS.get(version) or next((kind for name, kind in LAYOUTS if s.has(name)), None)
    return declared or next((kind for pattern, kind in CENSUS if s.any(pattern)), None)


def collect_files(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """Files of these suffixes at the top of a folder, or where there are none one level below, in order."""
    s = Store(spark, path)
    if s.is_file():
        return [path]
    for depth in ("", "*/"):
        found = sorted(f for x in suffixes for f in s.files(f"{depth}*{x}"))
        if found:
            return found
    return []


def resolve(spark: SparkSession, path: str) -> str:
    """The single data file of a folder that holds nothing else to be read; else the path itself."""
    if detect_format(spark, path) not in (HDF5, MESSAGE_LOG):
        return path
    found = collect_files(spark, path, tuple(SUFFIXES))
    return found[0] if len(found) == 1 else path


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """(episode_index, length, duration, tasks, has_intervention)."""
    fps = float(read_info(spark, path).get("fps") or 0)
    by_length = F.col("length") / fps if fps else F.lit(0.0)
    no = F.lit(False).alias("has_intervention")
    if detect_format(spark, path) == V3:
        for name in ("fps", "total_episodes"):
            if name not in read_info(spark, path):
                raise ValueError(f"{path}: meta/info.json has no {name}")
        e = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/meta/episodes")
        spans = [F.greatest(F.lit(0.0), F.col(f"`{c}`") - F.col(f"`{c[: -len('to_timestamp')]}from_timestamp`")) for c in e.columns if re.fullmatch(r"videos/.+/to_timestamp", c)]
        duration = (F.least(*spans) if len(spans) > 1 else spans[0]) if spans else by_length
        touched = [F.array_max(F.flatten(F.array(F.col(f"`{c}`").cast("array<double>")))) > 0 for c in e.columns if re.fullmatch(r"stats/.*is_intervene/max", c)]
        tasks = F.col("tasks") if "tasks" in e.columns else F.array().cast("array<string>")
        return e.select("episode_index", "length", duration.alias("duration"), tasks.alias("tasks"), touched[0].alias("has_intervention") if touched else no)
    if Store(spark, path).has("meta/episodes.jsonl"):
        e = spark.read.schema("episode_index long, length long, tasks array<string>, task string").option("mode", "FAILFAST").json(f"{path}/meta/episodes.jsonl")
        tasks = F.coalesce("tasks", F.when(F.col("task").isNotNull(), F.array("task")).otherwise(F.array().cast("array<string>")))
        return e.select("episode_index", "length", by_length.alias("duration"), tasks.alias("tasks"), no)
    n = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/data").groupBy("episode_index").agg(F.count(F.lit(1)).alias("length"))
    return n.select("episode_index", "length", by_length.alias("duration"), F.array().cast("array<string>").alias("tasks"), no)


def data_files(spark: SparkSession, path: str, episode_indices: list[int] | None) -> list[str]:
    """The data files that hold these episodes, by name in version 2 and by the episode rows in version 3; the data
    folder where all are wanted or the names do not tell."""
    whole = [f"{path}/data"]
    if episode_indices is None:
        return whole
    if detect_format(spark, path) == V2:
        s = Store(spark, path)
        return [f for i in sorted(set(episode_indices)) for f in s.files(f"data/chunk-*/episode_{i:06d}.parquet")] or whole
    e = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/meta/episodes")
    if not {"data/chunk_index", "data/file_index"} <= set(e.columns):
        return whole
    at = e.where(F.col("episode_index").isin(episode_indices)).select(F.col("`data/chunk_index`").alias("c"), F.col("`data/file_index`").alias("f")).distinct()
    return [f"{path}/data/chunk-{r.c:03d}/file-{r.f:03d}.parquet" for r in at.collect()] or whole  # files of a stated selection


def frames(spark: SparkSession, path: str, episode_indices: list[int] | None = None, keys: list[str] | None = None, merge_schema: bool = False, errors: bool = False) -> DataFrame:
    """Frame rows with their index columns and series. Default series start with ``action`` or
    ``observation.state``; named ones match exactly in version 2 and by beginning in version 3.
    With ``errors`` files that are broken or gone give no rows."""
    lenient = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"} if errors else {}
    d = spark.read.options(recursiveFileLookup="true", mergeSchema=str(merge_schema or errors).lower(), **lenient).parquet(*data_files(spark, path, episode_indices))
    exact = detect_format(spark, path) == V2
    wanted = tuple(keys) if keys else ("action", "observation.state")
    match = (lambda c: c in wanted) if keys and exact else (lambda c: c.startswith(wanted))
    d = d.select(*[F.col(f"`{c}`") for c in d.columns if c in INDEX_COLUMNS or match(c)])
    return d.where(F.col("episode_index").isin(episode_indices)) if episode_indices is not None else d


def long_series(frame_rows: DataFrame, key: str) -> DataFrame:
    """(episode_index, frame_index, dim, value) of a vector series."""
    return frame_rows.select("episode_index", "frame_index", F.posexplode(F.col(f"`{key}`").cast("array<double>")).alias("dim", "value"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines; broken ones are left out."""
    schema = "version int, target string, episode_index long, start_s double, end_s double, frame_index long, tags array<string>, quality_score int, success boolean, note string, updated_at string, updated_by string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def subset(frame_rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Frames of the selected episodes, renumbered from 0 in their order; ``index`` counts frames anew."""
    from epiframe.operators.datasets import merge_frames

    kept = frame_rows.join(selected.select("episode_index").distinct(), "episode_index", "left_semi").withColumn("source", F.lit(0)).drop("index")
    return merge_frames(kept).drop("source", "episode_index").withColumnRenamed("new_episode", "episode_index")


CHUNK = 1000
#: Renames under way at once when files get their names.
RENAMES = 16
#: Frames from which a shard of version 3 is followed by the next one.
SHARD_FRAMES = 1_000_000
#: Episode rows of one metadata file.
META_ROWS = 100_000
PATHS = {V2: "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", V3: "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet"}


def _prepared(frame_rows: DataFrame, fps: float, tasks: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames with all index columns, episode rows (episode_index, length, from, to, tasks), and the task table."""
    from epiframe.operators.datasets import cumulative_index, task_vocabulary
    from epiframe.operators.signals import global_index

    e = cumulative_index(frame_rows.groupBy("episode_index").agg(F.count(F.lit(1)).alias("length")))
    none = F.array().cast("array<string>")
    e = e.join(tasks.select("episode_index", "tasks"), "episode_index", "left").withColumn("tasks", F.coalesce("tasks", none)) if tasks is not None else e.withColumn("tasks", none)
    named = task_vocabulary(e.select("episode_index", F.posexplode("tasks").alias("at", "task")), "task", ["episode_index", "at"])
    first = e.select("episode_index", F.get("tasks", F.lit(0)).alias("task")).join(named, "task", "left").select("episode_index", F.coalesce("task_index", F.lit(0).cast("long")).alias("task_index"))
    d = global_index(frame_rows.drop("index", "timestamp", "task_index")).withColumn("timestamp", F.col("frame_index") / fps if fps else F.lit(0.0)).join(first, "episode_index")
    series = [c for c in frame_rows.columns if c not in INDEX_COLUMNS]
    return d.select(*INDEX_COLUMNS, *[F.col(f"`{c}`") for c in series]), e, named


def _vector_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("array<double>", "array<float>")]


def long_vectors(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, series, dim, value) of all vector columns."""
    each = F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").cast("array<double>").alias("v")) for c in _vector_columns(d)])
    return d.select(*keys, F.explode(each).alias("__s")).select(*keys, "__s.series", F.posexplode("__s.v").alias("dim", "value"))


def _with_stats(e: DataFrame, d: DataFrame) -> DataFrame:
    """Episode rows with ``stats/<series>/<metric>`` arrays by dimension; all series in one pass and one join."""
    from epiframe.operators.stats import bounded_stats

    names = _vector_columns(d)
    if not names:
        return e
    s = bounded_stats(long_vectors(d, ["episode_index"]), ["episode_index", "series", "dim"], "value").withColumn("count", F.col("count").cast("double"))
    metrics = [c for c in s.columns if c not in ("episode_index", "series", "dim")]
    rows = s.groupBy("episode_index").agg(*[F.sort_array(F.collect_list(F.when(F.col("series") == n, F.struct("dim", *metrics)))).alias(f"x{i}") for i, n in enumerate(names)])
    told = [F.when(F.size(f"x{i}") > 0, F.col(f"x{i}.{c}")).alias(f"stats/{n}/{c}") for i, n in enumerate(names) for c in metrics]
    return e.join(rows.select("episode_index", *told), "episode_index", "left")


def _info(version: str, kind: str, d: DataFrame, e: DataFrame, named: DataFrame, fps: float, robot_type: str | None) -> dict:
    widths = d.agg(*[F.max(F.size(F.col(f"`{c}`"))).alias(str(i)) for i, c in enumerate(_vector_columns(d))]).first() if _vector_columns(d) else ()
    features = {c: {"dtype": "int64" if c != "timestamp" else "float64", "shape": [1], "names": None} for c in INDEX_COLUMNS}
    for c, n in zip(_vector_columns(d), widths, strict=True):
        features[c] = {"dtype": "float64", "shape": [n or 0], "names": [f"{c}.d{i}" for i in range(n or 0)]}
    n, total = e.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    return {"codebase_version": version, "robot_type": robot_type, "fps": fps, "total_episodes": n, "total_frames": total, "total_tasks": named.count(), "chunks_size": CHUNK, "splits": {"train": f"0:{n}"}, "data_path": PATHS[kind], "video_path": None, "features": features}


def _write_files(df: DataFrame, s: Store, name_of) -> None:
    """Writes rows with ``__chunk`` and ``__file``, one file for each pair, and renames each to ``name_of(chunk, file)``."""
    staging = f"parts-{uuid.uuid4().hex}"
    df.write.partitionBy("__chunk", "__file").option("compression", "zstd").parquet(f"{s.path.toString()}/{staging}")
    named = lambda f: s.move(f, name_of(*(int(x) for x in re.search(r"__chunk=(\d+)/__file=(\d+)/", f).groups())))
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(named, s.files(f"{staging}/__chunk=*/__file=*/part-*.parquet")))
    s.delete(staging)


def _write_lines(df: DataFrame, s: Store, name: str) -> None:
    """One file of JSON lines; for tables of one row an episode or task."""
    staging = f"lines-{uuid.uuid4().hex}"
    df.coalesce(1).write.json(f"{s.path.toString()}/{staging}")
    parts = s.files(f"{staging}/part-*")
    s.move(parts[0], name) if parts else s.write_text(name, "")
    s.delete(staging)


def _published(spark: SparkSession, path: str, fill) -> None:
    """Lets ``fill`` write into a folder beside ``path``, which is renamed at the end."""
    if Store(spark, path).has("."):
        raise FileExistsError(path)
    building = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
    s = Store(spark, building)
    s.fs.mkdirs(s.path)
    try:
        fill(s)
        if not s.fs.rename(s.path, s.jvm.org.apache.hadoop.fs.Path(path)):
            raise OSError(f"could not publish {path}")
    except BaseException:
        s.fs.delete(s.path, True)
        raise


def fill_v2(s: Store, d: DataFrame, e: DataFrame, named: DataFrame, info: dict, stats: DataFrame | None = None) -> None:
    """The files of a version-2 dataset. ``stats`` (episode_index, ``stats/<series>/<metric>``) is taken from the frames
    where it is not given."""
    cut = d.withColumns({"__chunk": F.floor(F.col("episode_index") / CHUNK).cast("long"), "__file": F.col("episode_index")})
    _write_files(cut.repartition("episode_index").sortWithinPartitions("episode_index", "frame_index"), s, lambda c, f: f"data/chunk-{c:03d}/episode_{f:06d}.parquet")
    _write_lines(e.select("episode_index", "tasks", "length").orderBy("episode_index"), s, "meta/episodes.jsonl")
    _write_lines(named.select("task_index", "task").orderBy("task_index"), s, "meta/tasks.jsonl")
    stats = _with_stats(e.select("episode_index"), d) if stats is None else stats
    of: dict[str, list[str]] = {}
    for x in stats.columns:
        if x.startswith("stats/"):
            of.setdefault(x[len("stats/") :].rsplit("/", 1)[0], []).append(x)
    shaped = F.struct(*[F.struct(*[F.col(f"`{x}`").alias(x.rsplit("/", 1)[1]) for x in xs]).alias(c) for c, xs in of.items()]) if of else F.create_map().cast("map<string,string>")
    _write_lines(stats.select("episode_index", shaped.alias("stats")).orderBy("episode_index"), s, "meta/episodes_stats.jsonl")
    s.write_text("meta/info.json", json.dumps(info, indent=2))


def fill_v3(s: Store, d: DataFrame, e: DataFrame, named: DataFrame, info: dict, stats: DataFrame | None = None, shard_frames: int = SHARD_FRAMES) -> None:
    """The files of a version-3 dataset; ``stats`` as in version 2."""
    file = F.floor(F.col("from_index") / shard_frames).cast("long")
    e = e.withColumns({"data/chunk_index": F.floor(file / CHUNK).cast("long"), "data/file_index": file % CHUNK})
    at = e.select("episode_index", F.col("`data/chunk_index`").alias("__chunk"), F.col("`data/file_index`").alias("__file"))
    _write_files(d.join(at, "episode_index").repartition("__chunk", "__file").sortWithinPartitions("__chunk", "__file", "episode_index", "frame_index"), s, lambda c, f: f"data/chunk-{c:03d}/file-{f:03d}.parquet")
    rows = (_with_stats(e, d) if stats is None else e.join(stats, "episode_index", "left")).withColumnsRenamed({"from_index": "dataset_from_index", "to_index": "dataset_to_index"})
    part = F.floor(F.col("episode_index") / META_ROWS).cast("long")
    rows = rows.withColumns({"__chunk": F.floor(part / CHUNK).cast("long"), "__file": part % CHUNK})
    _write_files(rows.repartition("__chunk", "__file").sortWithinPartitions("episode_index"), s, lambda c, f: f"meta/episodes/chunk-{c:03d}/file-{f:03d}.parquet")
    _write_lines(named.select("task_index", "task").orderBy("task_index"), s, "meta/tasks.jsonl")
    s.write_text("meta/info.json", json.dumps(info, indent=2))


def write_v2(frame_rows: DataFrame, path: str, fps: float, robot_type: str | None = None, tasks: DataFrame | None = None) -> None:
    """A version-2 dataset: a file an episode; lines of episodes, their statistics and tasks; info."""
    d, e, named = _prepared(frame_rows, fps, tasks)
    _published(frame_rows.sparkSession, path, lambda s: fill_v2(s, d, e, named, _info("v2.1", V2, d, e, named, fps, robot_type)))


def write_v3(frame_rows: DataFrame, path: str, fps: float, robot_type: str | None = None, tasks: DataFrame | None = None, shard_frames: int = SHARD_FRAMES) -> None:
    """A version-3 dataset: shards of whole episodes in order, each ended by the episode that fills it; episode rows
    with their shard, index range and statistics; tasks; info."""
    d, e, named = _prepared(frame_rows, fps, tasks)
    _published(frame_rows.sparkSession, path, lambda s: fill_v3(s, d, e, named, _info("v3.0", V3, d, e, named, fps, robot_type), shard_frames=shard_frames))


def episode_stats(spark: SparkSession, path: str) -> DataFrame | None:
    """(episode_index, ``stats/<series>/<metric>`` arrays) as the dataset's own metadata tell them, or None."""
    if detect_format(spark, path) == V3:
        e = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/meta/episodes")
        return e.select("episode_index", *[F.col(f"`{c}`") for c in e.columns if c.startswith("stats/")])
    if not Store(spark, path).has("meta/episodes_stats.jsonl"):
        return None
    e = spark.read.option("mode", "FAILFAST").json(f"{path}/meta/episodes_stats.jsonl")
    of = dict(e.dtypes).get("stats", "")
    fields = e.schema["stats"].dataType.fields if of.startswith("struct") else []
    return e.select("episode_index", *[F.col(f"stats.`{f.name}`.`{m}`").alias(f"stats/{f.name}/{m}") for f in fields for m in f.dataType.fieldNames()])


def tasks_table(spark: SparkSession, path: str) -> DataFrame:
    """(task_index, task), from lines or else from Parquet."""
    s = Store(spark, path)
    if s.has("meta/tasks.jsonl"):
        return spark.read.schema("task_index long, task string").option("mode", "FAILFAST").json(f"{path}/meta/tasks.jsonl")
    return spark.read.parquet(f"{path}/meta/tasks.parquet").select(F.col("task_index").cast("long").alias("task_index"), "task")


def fidelity(source: str, target: str) -> str | None:
    """What a conversion keeps: all within a format, nearly all between the Parquet layouts, else a part; None where
    nothing writes the target. Logs are only ever copied as logs."""
    known = (V2, V3, HDF5, MESSAGE_LOG)
    if source not in known or (target not in WRITERS and not source == target == MESSAGE_LOG):
        return None
    return "full" if source == target else "high" if {source, target} == {V2, V3} else "partial"


#: Writers by format; others can be registered.
WRITERS = {V2: write_v2, V3: write_v3}


def convert(spark: SparkSession, source: str, target: str, to: str) -> None:
    """Copies a Parquet dataset into the layout ``to``."""
    if to not in WRITERS:
        raise ValueError(f"nothing writes {to}")
    info = read_info(spark, source)
    e = episodes(spark, source).select("episode_index", "tasks")
    WRITERS[to](frames(spark, source), target, float(info.get("fps") or 0), info.get("robot_type"), e)


def export(spark: SparkSession, source: str, target: str, selected: list[int], to: str | None = None, labels: DataFrame | None = None) -> dict:
    """Selected episodes as a dataset of their own, renumbered from 0, in the source's layout or another one, with the
    labels of what is kept under the new numbers, and a manifest, which is returned. Unknown episodes and lost frames
    are errors."""
    from epiframe.operators.tables import remap_episodes

    kind = detect_format(spark, source)
    kept = sorted({int(i) for i in selected})
    if fidelity(kind, to or kind) is None:
        raise ValueError(f"nothing writes {kind} as {to or kind}")
    if kind == MESSAGE_LOG:
        from epiframe.sources import log_episodes

        copied = sum(r.messages for r in log_episodes.subset(spark, source, kept, target).select("messages").collect())  # one row a log
        return {"source": source, "source_format": kind, "target_format": kind, "fidelity": "full", "episodes": {str(a): b for b, a in enumerate(kept)}, "messages": copied}
    mapping = spark.createDataFrame(list(zip(kept, range(len(kept)), strict=True)), "episode_index long, new_index long")
    e = episodes(spark, source)
    gone = [r.episode_index for r in mapping.join(e, "episode_index", "left_anti").orderBy("episode_index").collect()]
    if gone:
        raise ValueError(f"{source} has no episodes {gone}")
    info = read_info(spark, source)
    own = remap_episodes(e, mapping).select(F.col("new_index").alias("episode_index"), "tasks", "length")
    WRITERS[to or kind](subset(frames(spark, source, kept), mapping), target, float(info.get("fps") or 0), info.get("robot_type"), own.select("episode_index", "tasks"))
    want, have = own.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], frames(spark, target).count()
    if want != have:
        raise ValueError(f"{target} has {have} frames for {want}")
    s = Store(spark, target)
    if labels is not None:
        moved = remap_episodes(labels, mapping).drop("episode_index").withColumnRenamed("new_index", "episode_index")
        _write_lines(moved.orderBy("episode_index"), s, "meta/labels.jsonl")
    manifest = {"source": source, "source_format": kind, "target_format": to or kind, "fidelity": fidelity(kind, to or kind), "episodes": {str(a): b for b, a in enumerate(kept)}, "total_frames": have}
    s.write_text("meta/export_manifest.json", json.dumps(manifest, indent=2))
    return manifest
