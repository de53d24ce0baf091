"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts.

Training documents give exact counts of tokens and counts of bigrams. A bigram of count c goes into the filter
once for each level 1 .. 1 + floor(log2 c); a query probes level 1, 2, ... until one is missing, and the last
level found tells the count's power of two. The filter lies in slices, one a section, each sized from its own
entries at every scale; a block's distinct bigrams go to the sections that own the slices, which probe them and
answer with their levels, so no bigram is dropped and nothing that grows is broadcast.

The model interpolates: P(w | v) = a * c(vw) / c(v) + (1 - a) * U(w) with U(w) = (c(w) + 0.1) / (N + 0.1 (V + 1));
a is ``WEIGHT`` times one minus the filter's false-positive rate, and 0 where v was not seen. A level stands for the
least count of its range, so the bigrams of a history, false positives aside, add up to between a / 2 and a; what they
leave, a fifth of the whole at most, is kept for words that the training documents never had. So the probabilities
after a history never add up to more than one. A text's tokens are its lower-cased words and one end mark, which is
also what the first word follows.

Distinct words and bigrams are counted per block of documents before they are shuffled (see ``blocks``); words
and bigrams are told apart by 64-bit and about 46-bit hashes. Each section counts its words and bigrams, makes
its slice of the filter and answers the blocks, so the driver gets only sums.

Edge cases: null and empty texts have the end token only; a null doc_id counts as held out (its text is empty,
crc32 0); without training documents every token has probability 1; repeated rows count and are scored each;
extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm import blocks as B
from epiframe.llm.bpe import _packed, _rows
from epiframe.llm.common import materialize, table

BITS_PER_ENTRY, PROBES, MAX_LEVEL = 9.6, 6, 40
WEIGHT, ADD = 0.4, 0.1
FOLDS = 10
GRAMS, LEVELS, TOTALS = 3, 4, 5
END = b""
_REST = np.uint64((1 << 40) - 1)


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bigram_hash(v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Section and 40-bit rest of the bigrams of hashed words."""
    h = _mix(v * np.uint64(0x9E3779B97F4A7C15) + _mix(w))
    return (h >> np.uint64(40)) % np.uint64(n), h & _REST


def levels(count: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log2(count)).astype(np.int64), MAX_LEVEL)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the least of its range, so that a history's bigrams never add up to more
    than its count; 0 for level 0."""
    return np.where(level <= 0, 0.0, 2.0 ** (level - 1))


def _bits(rest: np.ndarray, level: int | np.ndarray, size: np.ndarray | int):
    """The probes' bit numbers, one array after the other, by double hashing."""
    a = _mix(rest * np.uint64(64) + np.asarray(level, np.uint64))
    b = _mix(a) | np.uint64(1)
    for _ in range(PROBES):
        yield a % np.asarray(size, np.uint64)
        a = a + b


def make_slice(rest: np.ndarray, count: np.ndarray, most_bits: int | None = None) -> np.ndarray:
    """A section's slice of the filter, as packed bits; ``score`` sets no ``most_bits``."""
    level = levels(count)
    bits = int(np.ceil(BITS_PER_ENTRY * level.sum() / 8))
    bits = 8 * max(1, bits if most_bits is None else min(bits, most_bits // 8))
    on = np.zeros(bits, np.bool_)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in _bits(rest[level >= j], j, bits):
            on[at] = True
    return np.packbits(on, bitorder="little")


class Filter:
    """Slices side by side. ``probe`` gives the level of each (section, rest)."""

    def __init__(self, slices: dict, n: int):
        """``slices``: buffers of packed bits by section."""
        parts = [np.frombuffer(slices.get(s, b"\0"), np.uint8) for s in range(n)]
        self.sizes = np.array([8 * len(p) for p in parts], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.uint64)
        self.data = np.concatenate(parts)
        self.on = sum(int(np.bitwise_count(self.data[i : i + (1 << 22)]).sum(dtype=np.int64)) for i in range(0, len(self.data), 1 << 22))

    def probe(self, section: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(rest), np.int64), np.arange(len(rest))
        for j in range(1, MAX_LEVEL + 1):
            start, size, r = self.starts[section[left]], self.sizes[section[left]], rest[left]
            hit = np.ones(len(left), np.bool_)
            for at in _bits(r, j, size):
                at = at + start
                hit &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            left = left[hit]
            if not len(left):
                break
            out[left] = j
        return out


def _pairs(codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of a block's distinct bigrams, and the bigram of each token."""
    before = np.concatenate([[end], codes[:-1]])
    pairs, back = np.unique(before.astype(np.uint64) << np.uint64(32) | codes.astype(np.uint64), return_inverse=True)
    return (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), back


def _dealt(v: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Section and rest of bigrams, and the order in which a block sends them and gets their levels."""
    section, rest = bigram_hash(v, w, n)
    return section, rest, np.lexsort((rest, section))


def _cut(n: int):
    def work(batches):
        for number, block in B.blocks_of(_rows(batches), tokens):
            words, codes = block.ranked()
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            section = (hashes % np.uint64(n)).astype(np.uint32)
            order = B.in_order(section)
            yield _packed(B.payload_rows(number, n, B.squeeze(*B.pack_ids(block.ids, block.lengths), *B.pack_codes(codes), B.planes(section), np.array([words.index(END)], "<i8").tobytes())))
            train = np.repeat([not held_out(i) for i in block.ids], block.lengths)
            counts = np.bincount(codes[train], minlength=len(words)).astype("<u4")
            for s, at, end in B.runs(section):
                own = order[at:end]
                yield _packed([(s, number, B.WORDS, s, B.squeeze(hashes[own].tobytes(), B.planes(counts[own])))])
            v, w, back = _pairs(codes, words.index(END))
            times = np.bincount(back[train], minlength=len(v))
            s2, rest, order = _dealt(hashes[v], hashes[w], n)
            s2, rest, times = s2[order], rest[order], times[order].astype("<u4")
            for s, at, end in B.runs(s2):
                yield _packed([(s, number, GRAMS, s, B.squeeze(B.planes(np.diff(rest[at:end], prepend=np.uint64(0))), B.planes(times[at:end])))])

    return work


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds, back = np.unique(keys, return_inverse=True)
    return kinds, np.bincount(back, weights=counts, minlength=len(kinds)).astype(np.int64), back


def _count(n: int):
    """Per section: counts the words and bigrams, makes the slice, answers the blocks. A task holds the packed
    words and bigrams of its section; sections follow the size of the input."""

    def work(batches):
        words, grams = defaultdict(list), defaultdict(list)
        for place, number, kind, section, data in _rows(batches):
            if kind == B.PAYLOAD:
                yield _packed([(place, number, kind, section, data)])
            elif kind == B.WORDS:
                words[section].append((number, data))
            else:
                grams[section].append((number, data))
        for s, got in words.items():
            parts = [B.unsqueeze(data) for _, data in got]
            hashes = [np.frombuffer(h, "<u8") for h, _ in parts]
            _, total, back = _sum_by(np.concatenate(hashes), np.concatenate([B.unplanes(c, "<u4") for _, c in parts]))
            at = 0
            for (number, _), h in zip(got, hashes, strict=True):
                yield _packed([(s, number, B.REPLY, s, B.squeeze(h.tobytes(), B.planes(total[back[at : at + len(h)]].astype("<u8"))))])
                at += len(h)
            yield _packed([(s, -1, TOTALS, s, np.array([total.sum(), np.count_nonzero(total), 0, 0], "<i8").tobytes())])
        for s, got in grams.items():
            parts = [B.unsqueeze(data) for _, data in got]
            kinds, total, back = _sum_by(np.concatenate([np.cumsum(B.unplanes(r, "<u8"), dtype=np.uint64) for r, _ in parts]), np.concatenate([B.unplanes(c, "<u4") for _, c in parts]))
            trained = total > 0  # the others are of held-out documents only
            grid = Filter({0: make_slice(kinds[trained], total[trained])}, 1)
            found = grid.probe(np.zeros(len(kinds), np.int64), kinds).astype(np.uint8)[back]
            at = 0
            for (number, _), (_, c) in zip(got, parts, strict=True):
                k = len(c) // 4
                yield _packed([(s, number, LEVELS, s, B.squeeze(found[at : at + k].tobytes()))])
                at += k
            yield _packed([(s, -1, TOTALS, s, np.array([0, 0, grid.on, 8 * len(grid.data)], "<i8").tobytes())])

    return work


def score(docs: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    n = B.sections(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(_cut(n), B.PACKED).repartitionById(n, F.col("place"))
    packed = materialize(packed.mapInArrow(_count(n), B.PACKED), "lm-packed")
    sums = np.zeros(4, np.int64)
    for r in packed.where(F.col("kind") == TOTALS).select("data").toLocalIterator():
        sums += np.frombuffer(r.data, "<i8")
    total, kinds, on, bits = sums.tolist()
    false_rate = (on / max(bits, 1)) ** PROBES

    def work(t: pa.Table) -> pa.Table:
        payload, got = B.split_payload(list(_rows(t.to_batches())))
        ids, none, lengths, first, two, four, section, end = B.unsqueeze(payload)
        ids, lengths = B.unpack_ids(ids, none, lengths)
        codes, order = B.unpack_codes(first, two, four).astype(np.int64), B.in_order(B.unplanes(section, "<u4"))
        replies = [B.unsqueeze(r[4]) for r in got if r[2] == B.REPLY]
        count, hashes = np.empty(len(order), np.int64), np.empty(len(order), np.uint64)
        hashes[order] = np.concatenate([np.frombuffer(h, "<u8") for h, _ in replies])
        count[order] = np.concatenate([B.unplanes(c, "<u8").astype(np.int64) for _, c in replies])
        single = (count + ADD) / (total + ADD * (kinds + 1))
        v, w, back = _pairs(codes, int(np.frombuffer(end, "<i8")[0]))
        level = np.empty(len(v), np.uint8)
        level[_dealt(hashes[v], hashes[w], n)[2]] = np.concatenate([np.frombuffer(B.unsqueeze(r[4])[0], np.uint8) for r in got if r[2] == LEVELS])
        a = np.where(count[v] > 0, weight * (1 - false_rate), 0.0)
        both = np.zeros(len(v))
        able = np.flatnonzero((count[v] > 0) & (count[w] > 0))
        found = level_count(level[able].astype(np.int64))
        both[able] = np.minimum(1.0, found / count[v[able]])
        pair = np.log10(a * both + (1 - a) * single[w])
        starts = np.cumsum(lengths) - lengths
        cols = {
            "doc_id": pa.array(ids, pa.int64()),
            "held_out": pa.array([held_out(i) for i in ids]),
            "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((count[codes] > 0).astype(np.int64), starts)),
            "train_tokens": pa.array(np.full(len(ids), total, np.int64)),
            "base_score": pa.array(np.add.reduceat(np.log10(single)[codes], starts)),
            "score": pa.array(np.add.reduceat(pair[back], starts)),
        }
        return pa.table(cols)

    answered = packed.where(F.col("kind").isin(B.PAYLOAD, B.REPLY, LEVELS))
    return answered.groupBy("block").applyInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op10_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
