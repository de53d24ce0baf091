"""Subsets and merges of message logs as logs, message by message and, where a window covers them, chunk by chunk.

A plan row is a run: the messages of one episode's window in one split of one file. Tasks copy runs into part files,
each a log of its own: a chunk that lies within the window goes over as it is, without being inflated, unless its
messages are to be re-timed or its channels have other numbers in the target; other chunks are read message by
message. A second step puts the parts of each target together in order, chunk by chunk, in one task a target, which
holds one chunk at a time. Part files have names of their own, so a repeated task disturbs nothing, and targets appear
complete. Definitions of schemas and channels, with their data and metadata, are gathered by a job; a log numbers them
in 16 bits, so they are few.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.sources import message_log as M

RUN = "target string, part long, file string, start long, end long, shift long, first_byte long, last_byte long"
PAUSE_NS = 3_000_000_000
#: Numbers that a log has for definitions of a kind.
MOST = (1 << 16) - 1


def definitions(path: str) -> list[tuple[int, bytes | None, bytes]]:
    """(number, schema, channel) of a file's channels, without their own numbers; from the summary, or from all records
    where that does not tell all."""
    f, size = M._open(path)
    with f:
        s = M.read_summary(f, size)
        if not s.whole:
            walk(M._read_records(f, size, len(M.MAGIC), size), s)
    out = []
    for (op, number), body in sorted(s.bodies.items()):
        if op == M.CHANNEL:
            schema = s.bodies.get((M.SCHEMA, struct.unpack_from("<H", body, 2)[0]))
            out.append((number, schema and schema[2:], body[4:]))
    return out


def walk(records: Iterator[tuple[int, bytes]], s: M.Summary) -> None:
    for op, b in records:
        s.define(op, b)
        if op == M.CHUNK:
            walk(M._records(inflated(b)), s)


def inflated(chunk: bytes) -> bytes:
    kind, at = M._string(chunk, 28)
    return M._inflate(kind, chunk[at + 8 : at + 8 + struct.unpack_from("<Q", chunk, at)[0]], struct.unpack_from("<Q", chunk, 16)[0])


def numbered(spark: SparkSession, files: list[str]) -> list[tuple[bytes | None, bytes]]:
    """(schema, channel) of all files; their places, from 1, are their numbers in a target. At most ``MOST`` reach the
    driver."""
    rows = spark.createDataFrame(list(enumerate(files)), "at long, file string").repartition(max(1, len(files) // 16))

    def read(batches):
        for b in batches:
            for at, path in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = definitions(path)
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.int64()), *(pa.array([d[i] for d in found], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary())))], names=["at", "number", "schema", "channel"])

    d = rows.mapInArrow(read, "at long, number int, schema binary, channel binary").groupBy("schema", "channel").agg(F.min(F.struct("at", "number")).alias("first"))
    out = [(r.schema and bytes(r.schema), bytes(r.channel)) for r in d.orderBy("first").limit(MOST + 1).collect()]
    if len(out) > MOST:
        raise ValueError(f"more than {MOST} channels")
    return out


def records(known: list[tuple[bytes | None, bytes]]) -> list[tuple[int, bytes]]:
    """Definitions as bodies of records, under their numbers."""
    schemas = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in known if s is not None), 1)}
    out = [(M.SCHEMA, struct.pack("<H", i) + s) for s, i in schemas.items()]
    return out + [(M.CHANNEL, struct.pack("<HH", i, schemas.get(s, 0)) + c) for i, (s, c) in enumerate(known, 1)]


def counted(chunk: bytes) -> list[bytes]:
    """Message indexes of a chunk that has none."""
    plain, at, out = inflated(chunk), 0, {}
    for op, b in M._records(plain):
        if op == M.MESSAGE:
            number, _, log, _ = struct.unpack_from("<HIQQ", b)
            out.setdefault(number, []).append((log, at))
        at += 9 + len(b)
    return [struct.pack("<HI", n, 16 * len(es)) + b"".join(struct.pack("<QQ", *e) for e in es) for n, es in sorted(out.items())]


def copy_run(log: M.LogWriter, path: str, span: tuple[int, int], start: int, end: int, shift: int | None, known: dict) -> int:
    """Puts the messages of the window into the log, with times counted from ``start`` and shifted where ``shift`` is
    given. Returns how many chunks went over as they were."""
    ids = {number: known[schema, channel] for number, schema, channel in definitions(path)}
    same, whole = shift is None and all(a == b for a, b in ids.items()), 0
    moved = (lambda t: t) if shift is None else (lambda t: max(0, t - start) + shift)
    f, size = M._open(path)
    with f:
        held: tuple[bytes, list[bytes]] | None = None

        def message(b: bytes) -> None:
            number, sequence, at, publish = struct.unpack_from("<HIQQ", b)
            if start <= at <= end:
                log.put(ids[number], sequence, moved(at), moved(publish), b[22:])

        def chunk(body: bytes, times: list[bytes]) -> int:
            first, last = struct.unpack_from("<QQ", body)
            if last < start or first > end:
                return 0
            if same and start <= first and last <= end:
                times = times or counted(body)
                if times:
                    log.put_chunk(body, times)
                return int(bool(times))
            for op, b in M._records(inflated(body)):
                if op == M.MESSAGE:
                    message(b)
            return 0

        for op, b in M._read_records(f, size, *span):
            if op == M.MESSAGE_INDEX and held:
                if len(b) > 6:
                    held[1].append(b)
                continue
            if held:
                whole += chunk(*held)
                held = None
            if op == M.CHUNK:
                held = b, []
            elif op == M.MESSAGE:
                message(b)
            elif op in (M.DATA_END, M.FOOTER):
                break
        if held:
            whole += chunk(*held)
    return whole


def runs(spark: SparkSession, windows: DataFrame, split_bytes: int = M.SPLIT_BYTES) -> DataFrame:
    """Rows of RUN from (target, at, file, start, end, shift): a run for every split that can hold messages of the
    window; parts are numbered in the order of ``at``, then of the file."""
    files = windows.select("file").distinct()

    def cut(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                spans = M.splits(path, split_bytes)
                f, size = M._open(path)
                with f:
                    chunks = M.read_summary(f, size).chunks if len(spans) > 1 else []
                times = [[(x[2], x[3]) for x in chunks if a <= x[0] < z] for a, z in spans]
                low, high = ([min((t[i] for t in ts), default=None) if i == 0 else max((t[i] for t in ts), default=None) for ts in times] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(spans)), pa.array([a for a, _ in spans], pa.int64()), pa.array([z for _, z in spans], pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["file", "first_byte", "last_byte", "low", "high"])

    spans = files.mapInArrow(cut, "file string, first_byte long, last_byte long, low long, high long")
    # splits before a file's first chunk and after its last one may hold messages of any time
    met = windows.join(spans, "file").where("low is null or (low <= end and high >= start)")
    part = F.row_number().over(Window.partitionBy("target").orderBy("at", "first_byte"))  # a row an episode and split
    return met.withColumn("part", part.cast("long")).select(*[c.split()[0] for c in RUN.split(", ")])


def written(spark: SparkSession, plan: DataFrame, files: list[str], folder: str, tasks: int) -> DataFrame:
    """Copies the runs of the plan and puts each target together in ``folder``: (target, messages, whole_chunks), which
    is held as local rows, one a target, since a lazy result would copy anew at every read."""
    known = numbered(spark, files)
    shared = spark.sparkContext.broadcast((records(known), {k: i for i, k in enumerate(known, 1)}))  # MOST definitions

    def copy(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                name = f"{folder}/.parts/{uuid.uuid4().hex}"
                log = M.LogWriter(name, definitions=shared.value[0])
                try:
                    whole = copy_run(log, r["file"], (r["first_byte"], r["last_byte"]), r["start"], r["end"], r["shift"], shared.value[1])
                except BaseException:
                    log.abandon()
                    raise
                log.close()
                out.append((r["target"], r["part"], name, whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], names=["target", "part", "name", "whole"])

    def join(found: pa.Table) -> pa.Table:
        rows = sorted(found.to_pylist(), key=lambda r: r["part"])
        log = M.LogWriter(f"{folder}/{rows[0]['target']}", definitions=shared.value[0])
        for r in rows:
            f, size = M._open(r["name"])
            with f:
                chunk, times = None, []
                for op, b in M._read_records(f, size, len(M.MAGIC), size):
                    if op == M.MESSAGE_INDEX:
                        times.append(b)
                        continue
                    if chunk:
                        log.put_chunk(chunk, times)
                    chunk, times = b if op == M.CHUNK else None, []
                    if op == M.DATA_END:
                        break
        log.close()
        return pa.table({"target": [rows[0]["target"]], "messages": [sum(log.counts.values())], "whole_chunks": [sum(r["whole"] for r in rows)]})

    system, own = M._system(folder)
    system.create_dir(f"{own}/.parts", recursive=True)
    parts = plan.repartition(tasks, "target", "part").mapInArrow(copy, "target string, part long, name string, whole long")
    done = parts.groupBy("target").applyInArrow(join, "target string, messages long, whole_chunks long").toArrow()
    system.delete_dir(f"{own}/.parts")
    return spark.createDataFrame(done) if done.num_rows else spark.createDataFrame([], "target string, messages long, whole_chunks long")


def publish(spark: SparkSession, windows: DataFrame, files: list[str], target: str, split_bytes: int = M.SPLIT_BYTES) -> DataFrame:
    """Writes the windows' messages into ``target``: one log where its name is a log's, else a folder of logs by the
    windows' ``target``. Nothing is there before all is."""
    system, own = M._system(target)
    if system.get_file_info(own).type != M.fs.FileType.NotFound:
        raise FileExistsError(target)
    single = target.endswith(".mcap")
    building = f"{target.rstrip('/')}.building-{uuid.uuid4().hex}"
    M._system(building)[0].create_dir(M._system(building)[1], recursive=True)
    windows = windows.withColumn("target", F.lit("log.mcap")) if single else windows
    try:
        out = written(spark, runs(spark, windows, split_bytes), files, building, spark.sparkContext.defaultParallelism * 4)
        system.move(M._system(f"{building}/log.mcap" if single else building)[1], own)
        if single:
            system.delete_dir(M._system(building)[1])
        return out
    except BaseException:
        system.delete_dir(M._system(building)[1])
        raise
