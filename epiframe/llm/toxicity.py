"""Toxic passages by maximum-scoring segments.

Tokens, and their first letters, get log odds of toxic against other labelled documents, with an informative Dirichlet prior; those whose
odds are not significant get a small negative score, so that sums over clean text drift down. A linear scan finds
all maximal-scoring segments of a document (Ruzzo and Tompa). Segment scores are turned into extreme values:
with lambda from the clean documents' score distribution and K from their observed maxima, a segment of score S
in n tokens has about K n exp(-lambda S) chance equals. A document's statistic is the sum of its significant
segments' excesses, or the best one if none is; Platt scaling makes it a probability. Lambda, K and that scaling come
from two halves of the sample, each judged by the odds of the other.

Training uses at most ``SAMPLE`` labelled rows, those least by a hash of their id, none of which is held out; a
document counts once per token, and exact copies count once. The model (significant tokens, bounded by the
sample) is shipped with the tasks. Every document is scored over its whole text.

Edge cases: null and empty texts get the score of a document without segments; without both labels in training
every score is 0; labels that contradict each other count for toxic; repeated rows are scored each; a null doc_id
is not held out (it has no remainder); extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.boosting import platt
from epiframe.llm.common import materialize, table

#: The prior of a token is PRIOR plus SHARE of its documents, in either class alike.
SAMPLE, PRIOR, SHARE, MIN_DOCS, Z, DRIFT = 20_000, 0.5, 0.02, 5, 3.4, 0.12
#: Log odds from which a significant token scores; below, it may be common in clean texts too.
MIN_ODDS = 3.0
CUT, FOLDS, HELD = 0.3, 4, 2
BEGINNINGS = (6, 5, 4, 3)
#: Tokens whose scores a worker remembers.
REMEMBERED = 500_000

_token = re.compile(rb"[a-z\x80-\xff]+")


def tokens(text: str) -> list[bytes]:
    """Runs of letters, with A-Z lower-cased."""
    return _token.findall(text.encode("utf-8", "surrogatepass").lower())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score), from the positive scores by position and the drift per
    token between them. Each positive token joins or opens a candidate; a candidate's link is the nearest earlier
    one with a smaller left sum, so no candidate is looked at more often than it is linked or merged."""
    out: list[list] = []  # first, last, left sum, right sum, link
    total, at = 0.0, 0
    for i, s in scores:
        total -= drift * (i - at)
        first, left, right = i, total, total + s
        total, at = right, i + 1
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                out.append([first, i, left, right, j])
                break
            first, left, link = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = link
    return [(a, b, r - left) for a, b, left, r, _ in out]


def units(word: bytes) -> list[str]:
    """A token as it is told apart: itself, and its beginnings of ``BEGINNINGS`` letters, marked by a tilde; the
    longest first."""
    text = word.decode("utf-8", "replace")
    return [text, *(text[:k] + "~" for k in BEGINNINGS if len(text) > k)]


class Model:
    """odds: score of each significant token; lam and k: of the extreme values; slope, offset: calibration."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.lam, self.k, self.slope, self.offset = odds, 1.0, 0.05, 0.0, -30.0
        self.seen: dict[bytes, float] = {}

    def of(self, word: bytes) -> float:
        """The score of a token: that of its longest known unit, or 0 for the drift."""
        if (s := self.seen.get(word)) is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            s = self.seen[word] = next((self.odds[u] for u in units(word) if u in self.odds), 0.0)
        return s

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and the maximal segments."""
        scored = [self.of(w) for w in tokens(text)]
        return len(scored), segments([(i, s) for i, s in enumerate(scored) if s > 0], DRIFT)

    def statistic(self, n: int, found: list[tuple[int, int, float]]) -> float:
        noise = np.log(max(self.k * n, 1e-9))
        values = [self.lam * s - noise for _, _, s in found]
        over = [v for v in values if v > 0]
        return float(sum(over)) if over else float(max(values, default=-noise - 5.0))

    def expected(self, n: int, s: float) -> float:
        """How many segments of this score or more chance gives in n tokens."""
        return float(min(self.k * n, 1e300) * np.exp(-self.lam * s))

    def score(self, n: int, found: list) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.statistic(n, found) + self.offset, -30, 30))))


def _lambda(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(lambda s) = 1."""
    low, high = 1e-6, 1.0
    mean = lambda x: float((weights * np.exp(np.minimum(x * values, 700))).sum() / weights.sum())
    while mean(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return low


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, half) of the bounded sample; copies of a text count once. ``half`` is a bit of the text's digest."""
    ids = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = ids.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE).select("doc_id", "toxic")
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id")
    keyed = rows.withColumn("same", F.sha2(F.col("text"), 256))
    return keyed.groupBy("same").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic", F.substring("same", 1, 1).isin(*"02468ace").cast("int").alias("half"))


def odds_of(counts: DataFrame, n0: str, n1: str) -> dict[str, float]:
    """Scores of the units that are significant by the two counts of documents, and zeros of those that begin like one
    and are not toxic themselves."""
    t0, t1 = counts.agg(F.coalesce(F.sum(n0), F.lit(0)), F.coalesce(F.sum(n1), F.lit(0))).first()
    if not t0 or not t1:
        return {}
    a = PRIOR + SHARE * (F.col(n0) + F.col(n1))
    size = SHARE * (t0 + t1)
    odds = lambda n, t: F.log((F.col(n) + a) / (t + size - F.col(n)))
    delta, spread = odds(n1, t1) - odds(n0, t0), F.sqrt(1 / (F.col(n1) + a) + 1 / (F.col(n0) + a))
    scored = counts.where(F.col(n0) + F.col(n1) >= MIN_DOCS).select("w", delta.alias("s"), (delta / spread).alias("z"))
    significant = (F.col("z") >= Z) & (F.col("s") >= MIN_ODDS)
    toxic = scored.where(significant).select("w", "s")
    # units that begin like a toxic one and are not toxic themselves keep their words from its score
    above = F.array(*[F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("~"))) for k in BEGINNINGS])
    other = scored.where(~significant).select("w", F.explode(above).alias("b")).join(toxic.select(F.col("w").alias("b")), "b", "left_semi").select("w").distinct()
    return {r.w: r.s for r in toxic.union(other.select("w", F.lit(0.0).alias("s"))).collect()}  # of MIN_DOCS documents of the sample at least


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Odds from all of the sample; lambda, K and the calibration from its two halves, each scanned with the other
    half's odds, so that no row is judged by odds that it had a part in."""
    spark = docs.sparkSession
    sample = materialize(training_rows(docs, labels), "toxic-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [Counter() for _ in range(4)]
        for b in batches:
            for text, toxic, half in zip(*b.columns, strict=True):
                n[2 * half.as_py() + (toxic.as_py() > 0)].update({u for w in set(tokens(text.as_py())) for u in units(w)})
        words = list({w for c in n for w in c})
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in n]], names=["w", "a0", "a1", "b0", "b1"])

    counts = sample.mapInArrow(count, "w string, a0 long, a1 long, b0 long, b1 long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])
    counts = materialize(counts.withColumns({"n0": F.col("a0") + F.col("b0"), "n1": F.col("a1") + F.col("b1")}), "toxic-counts")
    model = Model(odds_of(counts, "n0", "n1"))
    if not model.odds:
        return model
    other = spark.sparkContext.broadcast([Model(odds_of(counts, "b0", "b1")), Model(odds_of(counts, "a0", "a1"))])  # of the sample's words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [other.value[half.as_py()].scan(t.as_py()) for t, half in zip(b.column(0), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1).cast(pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for *_, s in x] for _, x in found], pa.list_(pa.float64()))], names=["toxic", "n", "s"])

    scanned = materialize(sample.mapInArrow(scan, "toxic long, n long, s array<double>"), "toxic-scanned")
    rows = scanned.select("toxic", "n", F.coalesce(F.array_max("s"), F.lit(0.0)).alias("best")).toPandas()  # three numbers a row of the sample
    clean = rows[rows.toxic == 0]
    # scores of clean rows by thousandths, so that their number does not grow with the texts
    ups = scanned.where("toxic = 0").select(F.explode("s").alias("s")).select(F.round("s", 3).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("k")).toPandas()
    values, weights = np.concatenate([[-DRIFT], ups.s if len(ups) else [1.0]]), np.concatenate([[max(1, int(clean.n.sum()))], ups.k if len(ups) else [1]])
    model.lam = min(_lambda(values, weights), 3.0)
    # by moments of the Gumbel law: mean of lambda S - log n is log K + Euler's constant
    model.k = float(np.clip(np.exp(np.mean(model.lam * clean.best - np.log(np.maximum(clean.n, 1))) - 0.5772), 1e-6, 1.0)) if len(clean) else model.k

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.statistic(n.as_py(), [(0, 0, v) for v in s.as_py()]) for n, s in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.float64())], names=["toxic", "x"])

    judged = scanned.mapInArrow(judge, "toxic long, x double").toPandas()  # two numbers a row of the sample
    judged = judged.sort_values(["x", "toxic"])  # sums in one order, whatever order tasks end in
    model.slope, model.offset = platt(np.clip(judged.x.to_numpy(), -40, 40), (judged.toxic > 0).to_numpy(float))
    return model


SEGMENT = "first long, last long, score double, expected double"


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, n_segments, segments) of every row. ``segments`` are the significant passages: first
    and last token, score, and how many such chance would give in a text of this length; n_segments counts all maximal
    ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for b in batches:
            found = [m.scan(t.as_py() or "") for t in b.column(2)]
            passages = [[{"first": i, "last": j, "score": s, "expected": e} for i, j, s in x if (e := m.expected(n, s)) < 1] for n, x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([m.score(n, s) for n, s in found], pa.float64()), pa.array([len(s) for _, s in found], pa.int64()), pa.array(passages, kind)], names=["doc_id", "held_out", "score", "n_segments", "segments"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc_id long, held_out boolean, score double, n_segments long, segments array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>")


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "n_segments")
