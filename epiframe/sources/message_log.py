"""Indexed message logs ("MCAP" containers) as Python data sources.

A file is split at its chunk index, so that a partition reads about ``splitBytes`` of it; a file without an index is one
partition. Records are read one after another, never a whole file. The options ``topics`` (comma-separated), ``since``
and ``until`` (log times) keep other records from being decoded; with ``errors`` set to ``rows`` what cannot be read
gives rows whose ``error`` tells why. They are options and not pushed filters, because Spark
4.1 keeps the filters that a Python reader has taken for later queries of the same DataFrame. The container is a magic
number, then records of an opcode byte, a 64-bit length and a body; chunks hold further records, plain or compressed,
and the summary before the footer repeats schemas and channels and tells counts and chunks.

    spark.dataSource.register(MessageLogSource)
    spark.read.format("message_log").option("topics", "/a").load(path)
    spark.dataSource.register(MessageLogSummarySource)
    spark.read.format("message_log_summary").load(path)
"""

from __future__ import annotations

import glob
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed values of the container format.
MAGIC = b"\x89MCAP0\r\n"
HEADER, FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, STATISTICS, DATA_END = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x0B, 0x0F
#: The footer's record and the closing magic number.
TAIL = 9 + 20 + len(MAGIC)

COLUMNS = "file string, topic string, schema_name string, schema_encoding string, message_encoding string, sequence long, log_time long, publish_time long, data binary, error string"
SUMMARY = "file string, topic string, schema_name string, message_encoding string, messages long, start_time long, end_time long, indexed boolean"

SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def log_files(path: str) -> list[str]:
    """Logs at a path: a file, a pattern of local files, or a folder, at its top or where it has none there one level
    below; sorted."""
    system, own = _system(path)
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    kind = system.get_file_info(own).type
    if kind == fs.FileType.Directory:
        listed = lambda d: system.get_file_info(fs.FileSelector(d))
        top = listed(own)
        found = [f.path for f in top if f.is_file and f.path.endswith(".mcap")]
        return sorted(prefix + p for p in found or [f.path for d in top if not d.is_file for f in listed(d.path) if f.is_file and f.path.endswith(".mcap")])
    return [path] if kind == fs.FileType.File else sorted(glob.glob(own))


def _string(b: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", b, at)[0]
    return b[at + 4 : at + 4 + n].decode(), at + 4 + n


def _records(b: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 9 <= len(b):
        op, n = struct.unpack_from("<BQ", b, at)
        if at + 9 + n > len(b):
            return  # a file that was cut off
        yield op, b[at + 9 : at + 9 + n]
        at += 9 + n


def _read_records(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Records that start within the range, one in memory at a time."""
    at = start
    while at < end and at + 9 <= size:
        f.seek(at)
        op, n = struct.unpack("<BQ", f.read(9))
        if at + 9 + n > size:
            return  # a file that was cut off
        yield op, f.read(n)
        at += 9 + n


def _inflate(kind: str, body: bytes, size: int) -> bytes:
    if not kind:
        return body
    return pa.Codec({"lz4": "lz4", "zstd": "zstd"}[kind]).decompress(body, decompressed_size=size).to_pybytes()


@dataclass
class Summary:
    """What a file's summary tells. ``whole``: it names all channels and chunks, so that parts can be read alone."""

    schemas: dict[int, tuple[str, str]] = field(default_factory=dict)
    channels: dict[int, tuple[int, str, str]] = field(default_factory=dict)
    bodies: dict[tuple[int, int], bytes] = field(default_factory=dict)
    chunks: list[tuple[int, int, int, int]] = field(default_factory=list)
    counts: dict[int, int] | None = None
    start: int | None = None
    end: int | None = None
    whole: bool = False

    def define(self, op: int, b: bytes) -> None:
        if op in (SCHEMA, CHANNEL):
            self.bodies[op, struct.unpack_from("<H", b)[0]] = b
        if op == SCHEMA:
            name, at = _string(b, 2)
            self.schemas[struct.unpack_from("<H", b)[0]] = (name, _string(b, at)[0])
        elif op == CHANNEL:
            number, schema = struct.unpack_from("<HH", b)
            topic, at = _string(b, 4)
            self.channels[number] = (schema, topic, _string(b, at)[0])


def read_summary(f, size: int) -> Summary:
    """The summary by way of the footer; an empty one where the file has none or was cut off."""
    s = Summary()
    if size < len(MAGIC) + TAIL:
        return s
    f.seek(size - TAIL)
    tail = f.read(TAIL)
    op, n, start, _, _ = struct.unpack_from("<BQQQI", tail)
    if not tail.endswith(MAGIC) or (op, n) != (FOOTER, 20) or not 0 < start < size - TAIL:
        return s
    told = None
    f.seek(start)
    for op, b in _records(f.read(size - TAIL - start)):
        s.define(op, b)
        if op == CHUNK_INDEX:
            first, last, at, length = struct.unpack_from("<QQQQ", b)
            s.chunks.append((at, length, first, last))
        elif op == STATISTICS:
            n, _, n_channels, _, _, n_chunks, s.start, s.end, n_bytes = struct.unpack_from("<QHIIIIQQI", b)
            s.counts = dict(struct.iter_unpack("<HQ", b[46 : 46 + n_bytes]))
            told = n_channels, n_chunks
            if sum(s.counts.values()) != n:
                s.counts = None
    s.chunks.sort()
    s.whole = told == (len(s.channels), len(s.chunks))
    return s


def _open(path: str):
    system, own = _system(path)
    f = system.open_input_file(own)
    if f.read(len(MAGIC)) != MAGIC:
        f.close()
        raise ValueError(f"{path} is no message log")
    return f, f.size()


def splits(path: str, split_bytes: int = SPLIT_BYTES) -> list[tuple[int, int]]:
    """Byte ranges of a file that can be read alone; they start at chunks and leave nothing out between them. The summary
    is looked up only where the file is longer than a split."""
    f, size = _open(path)
    with f:
        s = read_summary(f, size) if size > split_bytes else Summary()
    cuts = [len(MAGIC)]
    for at, *_ in s.chunks if s.whole else ():
        if at - cuts[-1] >= split_bytes:
            cuts.append(at)
    return list(zip(cuts, [*cuts[1:], size], strict=True))


def messages(path: str, topics: frozenset[str] | None = None, since: int | None = None, until: int | None = None, span: tuple[int, int] | None = None, errors: bool = False) -> Iterator[tuple]:
    """Rows of COLUMNS but the last in the order of the file, of the whole of it or of one of its ``splits``. Chunks out
    of the time window are not inflated where the summary names all channels; else they may define what later ones use.
    With ``errors`` a chunk or file that cannot be read gives a row without a topic, at the chunk's first time, whose
    tenth value tells why, and reading goes on behind it."""

    def failed(e: Exception, at: int | None) -> tuple:
        return path, None, None, None, None, None, at, None, None, f"{type(e).__name__}: {e}"

    try:
        f, size = _open(path)
    except (ValueError, OSError) as e:
        if not errors:
            raise
        yield failed(e, None)
        return
    with f:
        known = read_summary(f, size)

        def walk(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
            for op, b in records:
                if op in (SCHEMA, CHANNEL):
                    known.define(op, b)
                elif op == MESSAGE:
                    number, sequence, log, publish = struct.unpack_from("<HIQQ", b)
                    schema, topic, encoding = known.channels.get(number, (0, "", ""))
                    if (topics is None or topic in topics) and (since is None or log >= since) and (until is None or log <= until):
                        name, kind = known.schemas.get(schema, (None, None))
                        yield path, topic, name, kind, encoding, sequence, log, publish, b[22:]
                elif op == CHUNK:
                    first, last, n_plain, _ = struct.unpack_from("<QQQI", b)
                    if not known.whole or ((since is None or last >= since) and (until is None or first <= until)):
                        kind, at = _string(b, 28)
                        n = struct.unpack_from("<Q", b, at)[0]
                        try:
                            inner = list(walk(_records(_inflate(kind, b[at + 8 : at + 8 + n], n_plain))))  # a chunk
                        except (ValueError, OSError, KeyError, struct.error) as e:
                            if not errors:
                                raise
                            inner = [failed(e, first)]
                        yield from inner
                elif op in (DATA_END, FOOTER):
                    return

        yield from walk(_read_records(f, size, *(span or (len(MAGIC), size))))


def summary_rows(path: str) -> Iterator[tuple]:
    """Rows of SUMMARY, one a topic: from the footer, or from all messages where the summary tells no counts. Times are
    the file's. Channels of one topic add up; a topic without messages counts 0."""
    f, size = _open(path)
    with f:
        s = read_summary(f, size)
    if s.counts is not None and s.channels:
        n, about = Counter(), {}
        for number, (schema, topic, encoding) in sorted(s.channels.items()):
            n[topic] += s.counts.get(number, 0)
            about.setdefault(topic, (s.schemas.get(schema, (None, None))[0], encoding))
        start, end, indexed = (s.start, s.end, True) if sum(n.values()) else (None, None, True)
    else:
        n, about, start, end, indexed = Counter(), {}, None, None, False
        for _, topic, schema, _, encoding, _, at, _, _ in messages(path):
            n[topic] += 1
            about.setdefault(topic, (schema, encoding))
            start, end = (at, at) if start is None else (min(start, at), max(end, at))
    for topic, (schema, encoding) in about.items():
        yield path, topic, schema, encoding, n[topic], start, end, indexed


class LogWriter:
    """Writes a log chunk by chunk, with a summary; a channel is a topic with its schema and encodings. The file appears
    under its name when it is complete."""

    def __init__(self, path: str, compression: str = "zstd", chunk_bytes: int = CHUNK_BYTES, definitions: Iterable[tuple[int, bytes]] = ()):
        self.system, self.own = _system(path)
        self.building = f"{self.own}.{uuid.uuid4().hex}.tmp"
        self.entries: dict[int, list[tuple[int, int]]] = {}
        self.compression, self.chunk_bytes, self.at = compression, chunk_bytes, 0
        self.schemas: dict[tuple[str, str], int] = {}
        self.channels: dict[tuple, int] = {}
        self.counts: Counter = Counter()
        self.defined: list[bytes] = []
        self.index: list[bytes] = []
        self.chunk: list[bytes] = []
        self.size, self.first, self.last, self.start, self.end = 0, None, None, None, None
        self.out = self.system.open_output_stream(self.building)
        self._put(MAGIC + self._record(HEADER, self._text("") + self._text("epiframe")))
        for op, body in definitions:
            self.defined.append(self._record(op, body))
            self._put(self.defined[-1])

    @staticmethod
    def _text(s: str) -> bytes:
        return struct.pack("<I", len(s.encode())) + s.encode()

    @staticmethod
    def _record(op: int, body: bytes) -> bytes:
        return struct.pack("<BQ", op, len(body)) + body

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def _hold(self, record: bytes) -> None:
        self.chunk.append(record)
        self.size += len(record)

    def _define(self, record: bytes) -> None:
        self.defined.append(record)
        self._hold(record)

    def add(self, topic: str, schema: str, at: int, data: bytes, schema_encoding: str = "raw", message_encoding: str = "raw", publish: int | None = None) -> None:
        kind, key = (schema, schema_encoding), (topic, schema, schema_encoding, message_encoding)
        if kind not in self.schemas:
            n = self.schemas[kind] = len(self.schemas) + 1
            self._define(self._record(SCHEMA, struct.pack("<H", n) + self._text(schema) + self._text(schema_encoding) + struct.pack("<I", 0)))
        if key not in self.channels:
            n = self.channels[key] = len(self.channels) + 1
            self._define(self._record(CHANNEL, struct.pack("<HH", n, self.schemas[kind]) + self._text(topic) + self._text(message_encoding) + struct.pack("<I", 0)))
        number = self.channels[key]
        self.put(number, self.counts[number] & 0xFFFFFFFF, at, at if publish is None else publish, data)

    def put(self, number: int, sequence: int, at: int, publish: int, data: bytes) -> None:
        """A message of a channel by its number."""
        self.entries.setdefault(number, []).append((at, self.size))
        self._hold(self._record(MESSAGE, struct.pack("<HIQQ", number, sequence, at, publish) + data))
        self.counts[number] += 1
        self.first, self.last = (at, at) if self.first is None else (min(self.first, at), max(self.last, at))
        if self.size >= self.chunk_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.chunk:
            return
        first, last = (self.first, self.last) if self.first is not None else (0, 0)
        plain = b"".join(self.chunk)
        body = pa.Codec(self.compression).compress(plain, asbytes=True) if self.compression else plain
        chunk = struct.pack("<QQQI", first, last, len(plain), 0) + self._text(self.compression) + struct.pack("<Q", len(body)) + body
        times = [struct.pack("<HI", n, 16 * len(es)) + b"".join(struct.pack("<QQ", *e) for e in es) for n, es in sorted(self.entries.items())]
        self._chunk(chunk, times)
        self.chunk, self.size, self.first, self.last, self.entries = [], 0, None, None, {}

    def _chunk(self, chunk: bytes, times: list[bytes]) -> None:
        first, last, n_plain, _ = struct.unpack_from("<QQQI", chunk)
        kind, at = _string(chunk, 28)
        record, where = self._record(CHUNK, chunk), self.at
        self._put(record)
        places = b""
        for t in times:
            places += t[:2] + struct.pack("<Q", self.at)
            self._put(self._record(MESSAGE_INDEX, t))
        told = struct.pack("<QQQQI", first, last, where, len(record), len(places)) + places + struct.pack("<Q", self.at - where - len(record))
        self.index.append(self._record(CHUNK_INDEX, told + self._text(kind) + chunk[at : at + 8] + struct.pack("<Q", n_plain)))
        self.start, self.end = (first, last) if self.start is None else (min(self.start, first), max(self.end, last))

    def put_chunk(self, chunk: bytes, times: list[bytes]) -> None:
        """A chunk as it is, with its message indexes; its channels have been defined under the same numbers."""
        self._flush()
        self._chunk(chunk, times)
        for t in times:
            self.counts[struct.unpack_from("<H", t)[0]] += struct.unpack_from("<I", t, 2)[0] // 16

    def close(self) -> None:
        self._flush()
        self._put(self._record(DATA_END, struct.pack("<I", 0)))
        start, counts = self.at, b"".join(struct.pack("<HQ", *c) for c in sorted(self.counts.items()))
        kinds = Counter(d[0] for d in self.defined)
        told = struct.pack("<QHIIIIQQI", sum(self.counts.values()), kinds[SCHEMA], kinds[CHANNEL], 0, 0, len(self.index), self.start or 0, self.end or 0, len(counts))
        self._put(b"".join([*self.defined, *self.index, self._record(STATISTICS, told + counts)]))
        self._put(self._record(FOOTER, struct.pack("<QQI", start, 0, 0)) + MAGIC)
        self.out.close()
        self.system.move(self.building, self.own)

    def abandon(self) -> None:
        self.out.close()
        self.system.delete_file(self.building)


def write_log(path: str, rows: list[tuple[str, str, int, bytes]], compression: str = "zstd", chunk_bytes: int = CHUNK_BYTES) -> None:
    """A log of (topic, schema name, log_time, data) rows, in order of time."""
    log = LogWriter(path, compression, chunk_bytes)
    for topic, schema, at, data in sorted(rows, key=lambda r: r[2]):
        log.add(topic, schema, at, data)
    log.close()


class _Part(InputPartition):
    def __init__(self, path: str, span: tuple[int, int]):
        self.path, self.span = path, span


class _Reader(DataSourceReader):
    def __init__(self, path: str, options):
        self.path = path
        self.errors = options.get("errors") == "rows"
        topics, number = options.get("topics"), lambda k: int(options[k]) if k in options else None
        self.topics = frozenset(topics.split(",")) if topics else None
        self.since, self.until, self.split_bytes = number("since"), number("until"), number("splitBytes") or SPLIT_BYTES

    def partitions(self):
        return [_Part(p, s) for p in log_files(self.path) for s in self._splits(p)]

    def _splits(self, path):
        try:
            return splits(path, self.split_bytes)
        except (ValueError, OSError):
            if not self.errors:
                raise
            return [(0, 0)]

    def read(self, partition):
        for r in messages(partition.path, self.topics, self.since, self.until, partition.span, self.errors):
            yield r if len(r) == 10 else (*r, None)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _SummaryReader(DataSourceReader):
    def __init__(self, path: str, together: int, errors: bool):
        self.path, self.together, self.errors = path, together, errors

    def partitions(self):
        files = log_files(self.path)
        return [_Files(files[i : i + self.together]) for i in range(0, len(files), self.together)]

    def read(self, partition):
        for p in partition.paths:
            try:
                rows = list(summary_rows(p))  # one a topic
            except (ValueError, OSError, KeyError, struct.error):
                if not self.errors:
                    raise
                rows = []
            yield from rows


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class _Writer(DataSourceWriter):
    def __init__(self, path: str, options):
        self.path, self.compression = path, options.get("compression", "zstd")
        system, own = _system(path)
        system.create_dir(own, recursive=True)

    def write(self, rows):
        """One file per task, chunk by chunk; rows need topic, schema_name, log_time and data. Encodings and publish
        times are kept where there are such columns."""
        name, log = f"{self.path}/log-{uuid.uuid4().hex}.mcap", None
        try:
            for r in rows:
                log = log or LogWriter(name, "" if self.compression == "none" else self.compression)
                have = r.asDict()
                log.add(r.topic, r.schema_name or "", r.log_time, bytes(r.data), have.get("schema_encoding") or "raw", have.get("message_encoding") or "raw", have.get("publish_time"))
        except BaseException:
            if log:
                log.abandon()
            raise
        if log:
            log.close()
        return _Written([name] if log else [])

    def abort(self, messages):
        for m in messages:
            for name in m.files if m else []:
                system, own = _system(name)
                system.delete_file(own)


class MessageLogSource(DataSource):
    @classmethod
    def name(cls):
        return "message_log"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        return _Reader(self.options["path"], self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], self.options)


class MessageLogSummarySource(DataSource):
    @classmethod
    def name(cls):
        return "message_log_summary"

    def schema(self):
        return SUMMARY

    def reader(self, schema):
        return _SummaryReader(self.options["path"], int(self.options.get("filesPerTask", "16")), self.options.get("errors") == "rows")
