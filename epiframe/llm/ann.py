"""Approximate nearest neighbours: adaptive dimension scan within probed lists.

Vectors are dealt to the lists of a coarse quantizer. A query probes its nearest lists in two rounds: the first few
give a k-th distance, the others are scanned against it. Rotated vectors are scanned in blocks of columns; after each
block a hypothesis test compares a candidate's partial distance with the share of the query's present k-th distance
that true neighbours have by then, and candidates beyond it are abandoned. The shares are calibrated on the sample: of
its neighbours' partial distances, over their full ones, all but ``MISS`` lie below. The k-th distance only ever falls:
it is the first round's, or that of the k candidates of the piece which look nearest after the first block. Survivors
get their exact distance on the original vectors.

There are about twice as many lists as the square root of the vectors: up to ``COARSE`` centres, and beyond that each
centre's list is divided by a second quantizer, of what is left of a vector when its centre is taken off. Both, the
calibration and the number of probed lists are fitted on at most ``SAMPLE`` vectors, those least by a hash of their id:
probes grow by a tenth of the lists until the lists hold ``RECALL`` of the sample's own neighbours. Every vector is
indexed. A query whose probed lists hold too few vectors is scanned over all lists.

Equal vectors are one candidate and equal queries one search: of each vector only the k + 1 least ids can be
neighbours, since ties go to the least id, and the answer of equal queries is told to each of them. So a vector that a
third of all rows hold is scanned once. Lists are split into pieces of about ``PIECE`` vectors, and a list's queries
into parts of about ``PART``; each part meets each piece in a task of its own, with a bound of its own.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no
part, nor do rows with a null id; repeats of an id with its vector count once; a query whose id has several vectors is
taken with the least one, and the others are not replaced where they are among its nearest; rows with the query's id
are never its neighbours; ties go to the smaller id; fewer candidates than k give fewer rows; extra columns are
ignored; an empty table gives an empty one. Equal queries are told by a 128-bit digest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import materialize, table

K, SAMPLE, PIECE, PART, SEED, RECALL, COARSE = 10, 20_000, 8192, 1024, 7, 0.95, 4096
BLOCK, MISS = 16, 0.002
#: Of the probed lists, those of the first round; pairs of a query and a candidate that are scanned together.
FIRST, PAIRS = 0.125, 1 << 18
QUERY_EVERY = 100
#: Lists up to which their table (three numbers a list) is broadcast; with more of them it is joined by shuffle. Results
#: are the same either way.
BROADCAST_LISTS = 200_000


def valid(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return v if dim is None else v.where(F.size("v") == dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dim)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def _centres(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``n`` centres by Lloyd's steps."""
    distinct = np.unique(x, axis=0)
    out = distinct[rng.permutation(len(distinct))[:n]]
    for _ in range(8):
        near = _distances(x, out).argmin(1)
        k = np.bincount(near, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        out = np.where(k[:, None] > 0, sums / np.maximum(k, 1)[:, None], out)
    return out


class Quantizer:
    """Centres, parts of their lists, a rotation, and the number of lists to probe."""

    def __init__(self, x: np.ndarray, lists: int, coarse: int = COARSE):
        rng = np.random.default_rng(SEED)
        self.dim = x.shape[1]
        self.centres = _centres(x, min(lists, coarse), rng)
        near = _distances(x, self.centres).argmin(1)
        parts = -(-lists // coarse)
        self.parts = _centres(x - self.centres[near], parts, rng) if parts > 1 else np.zeros((1, self.dim))
        self.rotation = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        every = np.arange(0, len(x), max(1, len(x) // 200))
        d = _distances(x[every], x)
        d[np.arange(len(every)), every] = np.inf  # a query is none of its own neighbours
        k = min(K, len(x) - 1)
        near = np.argpartition(d, max(k - 1, 0), axis=1)[:, :k]
        want, ranked = self.lists_of(x)[near], self.order(x[every], self.lists)
        step = max(1, self.lists // 10)
        held = [(want[:, :, None] == ranked[:, None, :n]).any(2).mean() if k else 1.0 for n in range(step, self.lists, step)]
        self.probes = next((step * (i + 1) for i, r in enumerate(held) if r >= RECALL), self.lists)
        self.first = max(1, int(self.probes * FIRST))
        off = ((x[near] - x[every][:, None]) @ self.rotation) ** 2
        full = np.maximum(off.sum(2), 1e-300)
        self.limits = [float(np.quantile(off[:, :, :at].sum(2) / full, 1 - MISS)) if k else 1.0 for at in range(BLOCK, self.dim, BLOCK)]

    @property
    def lists(self) -> int:
        return len(self.centres) * len(self.parts)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        near = _distances(x, self.centres).argmin(1)
        return near * len(self.parts) + _distances(x - self.centres[near], self.parts).argmin(1)

    def order(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, among those of its n nearest centres."""
        n, m = min(n, self.lists), len(self.parts)
        near = _distances(x, self.centres).argsort(1, kind="stable")[:, :n]
        out = np.empty((len(x), n), np.int64)
        for i, q in enumerate(x):
            d = _distances(q - self.centres[near[i]], self.parts).ravel()
            best = np.argsort(d, kind="stable")[:n]
            out[i] = near[i][best // m] * m + best % m
        return out


def scan(q: np.ndarray, bounds: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, grid: Quantizer) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k nearest within one piece of each query that are not abandoned, as (query's place, id, distance), and how
    many dimensions were read. ``bounds``: squared k-th distances known before, or infinity."""
    turned, turned_q, out, read = x @ grid.rotation, q @ grid.rotation, [], 0
    for at in range(0, len(q), max(1, PAIRS // max(1, len(x)))):
        some = slice(at, at + max(1, PAIRS // max(1, len(x))))
        part = ((turned[None, :, :BLOCK] - turned_q[some, None, :BLOCK]) ** 2).sum(2)
        bound = bounds[some].copy()
        if len(x) > k and grid.limits:  # the present k-th distance is at most that of any k candidates
            look = np.argpartition(part, k - 1, axis=1)[:, :k]
            bound = np.minimum(bound, ((x[look] - q[some][:, None]) ** 2).sum(2).max(1))
        qi, ci = np.nonzero(np.ones(part.shape, bool))
        part = part.ravel()
        read += len(qi) * min(BLOCK, x.shape[1])
        for i, limit in enumerate(grid.limits):
            keep = part <= bound[qi] * limit * (1 + 1e-9) + 1e-12
            qi, ci, part = qi[keep], ci[keep], part[keep]
            nxt = slice((i + 1) * BLOCK, min((i + 2) * BLOCK, x.shape[1]))
            part = part + ((turned[ci, nxt] - turned_q[some][qi, nxt]) ** 2).sum(1)
            read += len(qi) * (nxt.stop - nxt.start)
        keep = part <= bound[qi] * (1 + 1e-9) + 1e-12
        qi, ci = qi[keep], ci[keep]
        d = np.sqrt(((x[ci] - q[some][qi]) ** 2).sum(1))
        best = np.lexsort((ids[ci], d, qi))
        qi, ci, d = qi[best], ci[best], d[best]
        rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
        out.append((qi[rank < k] + at, ids[ci][rank < k], d[rank < k]))
    return *(np.concatenate(c) for c in zip(*out, strict=True)), read


def _scanned(dealt: DataFrame, probes: DataFrame, shared, k: int) -> DataFrame:
    """(rep, vec_id, score): the k nearest of each (rep, q, bound, list) within the pieces of (vec_id, v, list)."""
    dim = shared.value.dim
    size = lambda d, per, name: d.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    cuts = size(dealt, PIECE, "pieces").join(size(probes, PART, "parts"), "list")
    if shared.value.lists <= BROADCAST_LISTS:  # one row a list
        cuts = F.broadcast(cuts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    asked = probes.join(cuts, "list").select("rep", "q", "bound", "list", own("rep", "parts").alias("part"), every("pieces").alias("piece"))
    held = dealt.join(cuts, "list").select("vec_id", "v", "list", own("vec_id", "pieces").alias("piece"), every("parts").alias("part"))

    def work(held: pa.Table, asked: pa.Table) -> pa.Table:
        reps, ids, d = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0)
        if held.num_rows and asked.num_rows:
            place, ids, d, _ = scan(_matrix(asked["q"], dim), np.asarray(asked["bound"], float), np.asarray(held["vec_id"], np.int64), _matrix(held["v"], dim), k, shared.value)
            reps = asked["rep"].combine_chunks().take(pa.array(place))
        return pa.table({"rep": reps, "vec_id": pa.array(ids, pa.int64()), "score": pa.array(d, pa.float64())})

    met = held.groupBy("list", "piece", "part").cogroup(asked.groupBy("list", "piece", "part")).applyInArrow(work, "rep string, vec_id long, score double")
    return _least(met, "rep", k)


def _least(found: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, coarse: int = COARSE) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query."""
    spark = vectors.sparkSession
    sizes = valid(vectors).groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = int(sizes.d), int(sizes.n)
    rows = valid(vectors, dim)
    drawn = rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id", "v").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows
    grid = Quantizer(_matrix(drawn["v"], dim), max(1, int(2 * np.sqrt(total))), coarse)
    shared = spark.sparkContext.broadcast(grid)  # 2 * COARSE centres and parts at most up to 2^48 vectors

    def deal(batches):
        for b in batches:
            near = shared.value.lists_of(_matrix(b.column(1), dim)) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int64())], names=["vec_id", "v", "list"])

    def probe(batches):
        for b in batches:
            if b.num_rows:
                near = shared.value.order(_matrix(b.column(1), dim), shared.value.probes)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.tolist(), pa.list_(pa.int64()))], names=["rep", "q", "lists"])

    same = Window.partitionBy("v").orderBy("vec_id")
    able = rows.withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1).select("vec_id", "v").distinct()
    dealt = materialize(able.mapInArrow(deal, "vec_id long, v array<double>, list long"), "ann-lists")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    asked = materialize(asked.withColumn("rep", F.md5(F.concat_ws(",", F.col("q").cast("array<string>")))), "ann-queries")
    reps = asked.groupBy("rep").agg(F.any_value("q").alias("q"))
    probes = materialize(reps.mapInArrow(probe, "rep string, q array<double>, lists array<long>").select("rep", "q", F.posexplode("lists").alias("near", "list")), "ann-probes")
    never = F.lit(float("inf"))
    near = probes.where(F.col("near") < grid.first).select("rep", "q", "list", never.alias("bound"))
    first = materialize(_scanned(dealt, near, shared, k + 1).select("rep", "vec_id", "score", "rank"), "ann-first")
    bounds = first.where(F.col("rank") == k + 1).select("rep", (F.col("score") * F.col("score")).alias("bound"))
    rest = probes.where(F.col("near") >= grid.first).join(bounds, "rep", "left").withColumn("bound", F.coalesce("bound", never))
    found = first.select("rep", "vec_id", "score").union(_scanned(dealt, rest, shared, k + 1).select("rep", "vec_id", "score"))
    found = materialize(_least(found, "rep", k + 1).select("rep", "vec_id", "score"), "ann-found")
    full = found.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(k + 1, dealt.count()))
    short = materialize(reps.join(full, "rep", "left_anti"), "ann-short")
    if not short.isEmpty():  # few lists' worth of vectors near: all lists
        again = _scanned(dealt, short.select("rep", "q", never.alias("bound"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.lists - 1).cast("long"))).alias("list")), shared, k + 1)
        found = found.join(short.select("rep"), "rep", "left_anti").union(again.select("rep", "vec_id", "score"))
    salts = asked.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("salts"))
    told = found.join(salts, "rep").select("rep", "vec_id", "score", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    each = asked.select("query_id", "rep").join(salts, "rep").select("query_id", "rep", F.pmod(F.xxhash64("query_id"), F.col("salts")).cast("int").alias("salt"))
    out = _least(each.join(told, ["rep", "salt"]).where("vec_id <> query_id").select("query_id", "vec_id", "score"), "query_id", k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
