"""Blocks of documents as packed rows, for operators that shuffle distinct words instead of occurrences.

A block is a run of documents of one input partition, of at most ``BLOCK_CHARS`` characters (a longer
document is a block of its own). Its distinct words get codes in order of falling frequency; what crosses the
shuffle is, per section of the word hash, the block's words of that section, and once per exchange the
block's documents as code sequences. Packed rows are few and large, so the shuffle moves bytes, not objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 16_000_000
#: Columns of packed rows: the section or place that a row is dealt to, its block, kind, section and bytes.
PACKED = "place int, block long, kind int, section int, data binary"
PAYLOAD, WORDS, REPLY = 0, 1, 2
_ESCAPE = 240


#: Bytes of input for which there is a section, at the least: what a task holds of its section is in proportion.
SECTION_BYTES = 32_000_000


def sections(docs: DataFrame) -> int:
    """As many sections as the session has shuffle partitions, and as the bytes of the texts ask for. They are counted:
    the planner's estimate multiplies over joins. What makes the input, a join say, therefore runs once more."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SECTION_BYTES))


#: Bytes of a payload that travel together.
PIECE = 1 << 16


def payload_rows(number: int, n: int, data: bytes) -> list[tuple]:
    """A block's payload in pieces, numbered as sections, each at a place by a digest of block and piece: numbers of
    first blocks are multiples of 2^32, and whole payloads are many times the words of a section."""
    place = lambda i: xxhash.xxh64_intdigest(number.to_bytes(8, "little"), i) % n
    return [(place(i), number, PAYLOAD, i, data[i * PIECE : (i + 1) * PIECE]) for i in range(-(-len(data) // PIECE))]


def split_payload(rows: list[tuple]) -> tuple[bytes, list[tuple]]:
    """The payload of a block's rows, put together, and its other rows by kind and section."""
    rows = sorted(rows, key=lambda r: (r[2], r[3]))
    n = sum(r[2] == PAYLOAD for r in rows)
    return b"".join(r[4] for r in rows[:n]), rows[n:]


def squeeze(*parts: bytes) -> bytes:
    """Byte strings into one, compressed."""
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unsqueeze(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lengths = np.frombuffer(raw, "<i8", n, 8).tolist()
    out, at = [], 8 * (n + 1)
    for k in lengths:
        out.append(raw[at : at + k])
        at += k
    return out


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, which compress better than the integers."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    k = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(k, -1).T).view(dtype).ravel()


def pack_codes(codes: np.ndarray) -> list[bytes]:
    """Codes below 240 take a byte; others an escape byte and two or four more."""
    small = codes < _ESCAPE
    rest = codes[~small]
    wide = rest >= 1 << 16
    first = np.where(small, codes, _ESCAPE).astype(np.uint8)
    first[np.flatnonzero(~small)[wide]] = _ESCAPE + 1
    return [first.tobytes(), planes(rest[~wide].astype("<u2")), planes(rest[wide].astype("<u4"))]


def unpack_codes(first: bytes, two: bytes, four: bytes) -> np.ndarray:
    f = np.frombuffer(first, np.uint8)
    out = f.astype(np.uint32)
    out[f == _ESCAPE] = unplanes(two, "<u2")
    out[f == _ESCAPE + 1] = unplanes(four, "<u4")
    return out


def pack_words(words: list[bytes]) -> list[bytes]:
    return [planes(np.fromiter(map(len, words), "<u4", len(words))), b"".join(words)]


def unpack_words(lengths: bytes, joined: bytes) -> list[bytes]:
    ends = np.cumsum(unplanes(lengths, "<u4").astype(np.int64)).tolist()
    starts = [0, *ends[:-1]] if ends else []
    return [joined[a:b] for a, b in zip(starts, ends, strict=True)]


class Codes(dict):
    """A dictionary that gives every new word the next code."""

    def __missing__(self, word):
        self[word] = code = len(self)
        return code


class Block:
    """Collects documents: ids (null allowed), flags and code sequences."""

    def __init__(self):
        self.codes, self.ids, self.lengths, self.parts, self.chars = Codes(), [], [], [], 0

    def add(self, doc_id, words: list, chars: int) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words)))
        self.chars += chars

    def ranked(self) -> tuple[list, np.ndarray]:
        """Words in order of falling frequency, and all documents' codes in that order's terms."""
        words = list(self.codes)
        all_codes = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint32)
        order = np.argsort(-np.bincount(all_codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        return [words[i] for i in order.tolist()], rank[all_codes] if len(words) else all_codes


def pack_ids(ids: list, lengths: list[int]) -> list[bytes]:
    return [np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.array([i is None for i in ids], np.uint8).tobytes(), planes(np.array(lengths, "<u4"))]


def unpack_ids(ids: bytes, none: bytes, lengths: bytes) -> tuple[list, np.ndarray]:
    gone = np.frombuffer(none, np.uint8)
    return [None if z else i for i, z in zip(np.frombuffer(ids, "<i8").tolist(), gone.tolist(), strict=True)], unplanes(lengths, "<u4").astype(np.int64)


def blocks_of(rows: Iterable[tuple], words_of: Callable[[str], list]) -> Iterator[tuple[int, Block]]:
    """(doc_id, text) rows to numbered blocks; numbers are of the task's partition, so a retried task gives
    the same ones."""
    base, k, block = TaskContext.get().partitionId() << 32, 0, Block()
    for doc_id, text in rows:
        text = text or ""
        if block.chars and block.chars + len(text) > BLOCK_CHARS:
            yield base + k, block
            k, block = k + 1, Block()
        block.add(doc_id, words_of(text), len(text) + 1)
    if block.ids:
        yield base + k, block


def by_section(words: list, n: int, digest: Callable[[bytes], int]) -> np.ndarray:
    """The section of each word."""
    return (np.fromiter(map(digest, words), np.uint64, len(words)) % np.uint64(n)).astype(np.uint32)


def runs(section: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(section, from, to) of each section that has words, in the order of ``in_order``."""
    kinds, n = np.unique(section, return_counts=True)
    ends = np.cumsum(n)
    return zip(kinds.tolist(), (ends - n).tolist(), ends.tolist(), strict=True)


def in_order(section: np.ndarray) -> np.ndarray:
    """Where the words of section 0, then 1, ... stand in the block's order."""
    return np.argsort(section, kind="stable")
