"""Byte-level BPE over documents by a global shuffle of distinct words.

Encoding: texts are cut into pre-tokens; each block of documents keeps its pre-tokens' positions as code
sequences and sends its distinct pre-tokens to their sections, where each distinct one is encoded once (again only
if a section has more than ``REMEMBERED`` of them); the ids are joined back to the block and put together by
position. Decoding looks ids up in the broadcast table of token bytes, in place of joining a row for each id. The vocabulary
is read from a rank file whose path is a parameter, and broadcast (its size is the file's: some 50,000 tokens, under
2 MB).

``encode_by_rows`` and ``decode_by_rows`` are the same in plain DataFrame steps: explode with positions, distinct,
join, reassemble. They move a row of some 40 bytes for each token, where packed blocks move some 3 bytes, and are the
twins that the tests hold the packed form against.

What is shuffled is the code sequences (about 1.4 bytes a token), twice, and the distinct words of each block.

The pre-token pattern is compiled for Python's ``re`` with character classes read off the tokenizer library
itself, so that letters, numbers and white space are what that library takes them to be; texts below U+0250
use a shorter table of the same classes, which matches faster.

Edge cases: null text counts as empty and has no ids; null and repeated doc_ids are kept row by row; special
tokens' strings are ordinary text; extra columns are ignored by encoding and kept by decoding, where ``bytes`` takes
the place of a column of that name; null ids have null bytes; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm import blocks as B
from epiframe.llm.common import materialize, table

VOCABULARY = "byte_bpe_50k.tiktoken"
_LATIN = 0x250
#: Pre-tokens that are put together at once, and distinct ones whose ids a task remembers.
_AT_ONCE, REMEMBERED = 200_000, 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _class_of(what: str) -> str:
    """All code points that the library's regex engine counts to a class, by having it tokenize them: bytes
    outside the class are left out of its tokens."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=what, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    return bytes(probe.encode_ordinary(every)).decode()


def _ranges(chars: str, below: int) -> str:
    """Sorted characters as the inside of a character class."""
    points = np.array([ord(c) for c in chars if ord(c) < below])
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(f"\\U{part[0]:08x}-\\U{part[-1]:08x}" for part in np.split(points, cuts))


@functools.cache
def _splitter(pattern: str, below: int) -> re.Pattern:
    """The pattern with its classes written out, for texts of code points under ``below``."""
    space, letter, number = (_ranges(_class_of(c), below) for c in (r"\s", r"\p{L}", r"\p{N}"))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]")
    return re.compile(out.replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]"))


_beyond_latin, _beyond_bmp = re.compile("[^\x00-ɏ]"), re.compile("[^\x00-￿]")


def pre_tokens(text: str, pattern: str = public_tokenizers.PATTERN) -> list[str]:
    below = _LATIN if text.isascii() or not _beyond_latin.search(text) else 0x10000 if not _beyond_bmp.search(text) else 0x110000
    return _splitter(pattern, below).findall(text)


def piece_encoder(ranks: dict[bytes, int], pattern: str):
    """The library's encoding of one pre-token's bytes, without a split."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(b.column(k)[i].as_py() for k in range(b.num_columns))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["place", "block", "kind", "section", "data"])


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every row of (doc_id, text)."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))
    n = B.sections(docs)

    def cut(batches):
        for number, block in B.blocks_of(_rows(batches), lambda t: pre_tokens(t, pattern)):
            words, codes = block.ranked()
            words = [w.encode() for w in words]
            section = B.by_section(words, n, xxhash.xxh64_intdigest)
            order = B.in_order(section)
            yield _packed(B.payload_rows(number, n, B.squeeze(*B.pack_ids(block.ids, block.lengths), *B.pack_codes(codes), B.planes(section))))
            for s, at, end in B.runs(section):
                yield _packed([(s, number, B.WORDS, s, B.squeeze(*B.pack_words([words[i] for i in order[at:end].tolist()])))])

    def encode_words(batches):
        one, known = piece_encoder(ranks.value, pattern), {}
        for place, number, kind, section, data in _rows(batches):
            if kind == B.PAYLOAD:
                yield _packed([(place, number, kind, section, data)])
                continue
            words = B.unpack_words(*B.unsqueeze(data))
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = one(w)
            ids = [known[w] for w in words]
            flat = np.fromiter((i for x in ids for i in x), "<u4")
            yield _packed([(place, number, B.REPLY, section, B.squeeze(B.planes(np.fromiter(map(len, ids), "<u4", len(ids))), B.planes(flat)))])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        payload, rows = B.split_payload(list(_rows(batches)))
        *head, first, two, four, section = B.unsqueeze(payload)
        doc_ids, lengths = B.unpack_ids(*head)
        codes, order = B.unpack_codes(first, two, four), B.in_order(B.unplanes(section, "<u4"))
        replies = [B.unsqueeze(r[4]) for r in rows]
        del rows, payload
        sizes = np.concatenate([np.zeros(0, np.int64)] + [B.unplanes(a, "<u4").astype(np.int64) for a, _ in replies])
        flat = np.concatenate([np.zeros(0, np.int32)] + [B.unplanes(b, "<u4").astype(np.int32) for _, b in replies])
        size, start = np.empty_like(sizes), np.empty_like(sizes)
        size[order], start[order] = sizes, np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < len(doc_ids):  # some documents at a time
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _AT_ONCE, "right")) - 1)
            part = codes[ends[at] : ends[to]]
            k = size[part]  # ids of each pre-token, in the documents' order
            where = np.repeat(start[part] - (np.cumsum(k) - k), k) + np.arange(k.sum())
            own = np.concatenate([[0], np.cumsum(k)])[ends[at : to + 1] - ends[at]]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(flat[where], pa.int32()))], names=["doc_id", "ids"])
            at = to

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, B.PACKED)
    answered = packed.repartitionById(n, F.col("place")).mapInArrow(encode_words, B.PACKED)
    return answered.groupBy("block").applyInArrow(put_together, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``bytes``, what the ids stand for, to rows with ``ids``, by looking them up in the broadcast table of token
    bytes, which is of the vocabulary's size. ``decode_by_rows`` is the join of ids with that table as rows, and gives the
    same; it shuffles a row for each id, and so goes beyond the disk that is allowed for large tables."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    of_token = encoded.sparkSession.sparkContext.broadcast([b for b, _ in sorted(ranks.items(), key=lambda x: x[1])])

    encoded = encoded.drop("bytes")

    def work(batches):
        get = of_token.value.__getitem__
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids"))
            found = [b"".join(map(get, ids[i].values.to_numpy().tolist())) if ids[i].is_valid else None for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, "bytes"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(work, f"{kept}, bytes binary")


def encode_by_rows(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of every row, in plain steps: one row a pre-token."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(path or public_tokenizers.path(VOCABULARY)))

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pre_tokens(t or "", pattern))

    @F.pandas_udf("array<int>")
    def ids_of(words: pd.Series) -> pd.Series:
        return words.map(lambda w, one=piece_encoder(ranks.value, pattern): one(w.encode()))

    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")), "bpe-rows")
    tokens = rows.select("row", F.posexplode(cut(F.coalesce("text", F.lit("")))).alias("at", "word"))
    met = tokens.join(tokens.select("word").distinct().select("word", ids_of("word").alias("part")), "word")
    whole = met.groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"])).alias("ids"))
    return rows.select("row", "doc_id").join(whole, "row", "left").select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode_by_rows(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes) of (doc_id, ids) rows, in plain steps: ids join the table of token bytes row by row."""
    ranks = read_ranks(path or public_tokenizers.path(VOCABULARY))
    tokens = encoded.sparkSession.createDataFrame(list(ranks.items()), "piece binary, id int")
    rows = materialize(encoded.select("doc_id", "ids", F.monotonically_increasing_id().alias("row")), "bpe-ids")
    met = rows.select("row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(tokens), "id")  # the vocabulary
    whole = met.groupBy("row").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: F.hex(x["piece"])), "")).alias("bytes"))
    return rows.join(whole, "row", "left").select("doc_id", F.when(F.col("ids").isNotNull(), F.coalesce("bytes", F.lit(b""))).alias("bytes"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(table(spark, sf_dir, "documents")))
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text.cast("binary"), 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
