"""Whitening of embeddings by a tiled covariance.

Entries become whole numbers, floor(256 c), so counts and sums are exact. The fit list is each distinct vector once.
Its covariance is computed in tiles: batches of rows are row blocks; each sends its columns, in blocks of ``WIDTH``, to
every tile key (pair of column blocks) that needs them; where a row block's pair meets, the blocks are centred and
multiplied, and the products are summed per entry of the tile. So a task holds two blocks of ``ROWS`` rows, whatever
the number of rows and dimensions, and a vector that many rows hold counts before the shuffle is over. Only sums,
entries of the covariance and eigenvectors (dimensions squared, not rows) reach the driver, which takes the
eigenvectors apart; rows are projected where they are.

Edge cases: rows whose vector is null, empty, of another length than most (ties: the shorter), or holds a null or
non-finite entry take no part; repeated rows and null ids are kept; entries beyond a long are held at its ends, and a
deviation beyond a long is null; components without variance (a share below ``LEAST`` of the largest) are left out, so
one distinct vector gives no rows, and fewer dimensions than components give fewer; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import materialize, table

COMPONENTS, SCALE, LEAST = 4, 256, 1e-11
#: Rows and columns of a block.
ROWS, WIDTH = 10_000, 32
COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the rows that take part, with whole numbers for entries."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    if x.dtype.kind == "f" or not x.size:
        return x
    low, high = int(x.min()), int(x.max())
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def sums(fit: DataFrame, column: str, dim: int) -> tuple[int, list]:
    """How many rows there are, and the sums of each dimension: exact for whole numbers."""
    kind = "double" if fit.schema[column].dataType.elementType.typeName() == "double" else "decimal(38,0)"

    def part(batches):
        n, total = 0, None
        for b in batches:
            x = _matrix(b.column(0), dim)
            s = x.sum(0) if x.dtype.kind == "f" else x.astype(object).sum(0)
            n, total = n + len(x), s if total is None else total + s
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    parts = fit.select(column).mapInArrow(part, "n long, s array<string>")
    told = parts.select("n", F.posexplode("s").alias("d", "s")).groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(kind)).alias("s")).orderBy("d").collect()  # dim rows
    return (told[0].n, [r.s if kind == "double" else int(r.s) for r in told]) if told else (0, [])


def covariance(fit: DataFrame, column: str, n: int, mean: np.ndarray) -> np.ndarray:
    """The covariance of an array column, divisor n, centred before multiplying."""
    dim, blocks = len(mean), -(-len(mean) // WIDTH)
    shared = fit.sparkSession.sparkContext.broadcast(mean)  # dim numbers
    span = lambda i: slice(i * WIDTH, min((i + 1) * WIDTH, dim))

    def cut(batches):
        """A row for each column block of a row block and each tile that it is part of."""
        from pyspark import TaskContext

        base, k, kinds = TaskContext.get().partitionId() << 32, 0, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = _matrix(b.column(0).slice(at, ROWS), dim)
                out = []
                for i in range(blocks):
                    held = _narrow(x[:, span(i)])
                    data = held.tobytes()
                    out += [(base + k, min(i, j), max(i, j), i, held.dtype.str, data) for j in range(blocks)]
                k += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["rows", "i", "j", "side", "kind", "data"])

    def multiply(met: pd.DataFrame) -> pd.DataFrame:
        i, j = int(met["i"].iloc[0]), int(met["j"].iloc[0])
        side = {int(s): np.frombuffer(d, k).reshape(-1, span(s).stop - span(s).start) - shared.value[span(s)] for s, k, d in zip(met["side"], met["kind"], met["data"], strict=True)}
        return pd.DataFrame({"i": [i], "j": [j], "product": [(side[i].T @ side[j]).ravel()]})

    dealt = fit.select(column).mapInArrow(cut, "rows long, i int, j int, side int, kind string, data binary")
    tiles = dealt.groupBy("rows", "i", "j").applyInPandas(multiply, "i int, j int, product array<double>")
    entries = tiles.select("i", "j", F.posexplode("product").alias("at", "p")).groupBy("i", "j", "at").agg(F.sum("p").alias("p"))
    out = np.zeros((dim, dim))
    for b in entries.toArrow().to_batches():  # half of dim squared, and a little more
        i, j, at, p = (np.asarray(c) for c in b.columns)
        wide = np.minimum(WIDTH, dim - j * WIDTH)
        r, c = i * WIDTH + at // wide, j * WIDTH + at % wide
        out[r, c] = out[c, r] = p
    return out / n


@dataclass
class Whitening:
    """What the fit list tells: its size and sums, eigenvalues by falling size and their unit vectors as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def __post_init__(self):
        self.mean = np.array([s / self.n for s in self.sums])
        self.kept = int((self.values > LEAST * max(self.values[0], 0)).sum())

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of each row, exact, or None where it is beyond a long."""
        most = max(map(abs, self.sums)) + self.n * (max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0)
        exact = np.int64 if most * most * x.shape[1] < 1 << 63 else object
        off = x.astype(exact) * self.n - np.array(self.sums, exact)
        return [d if d < 1 << 63 else None for d in (off * off).sum(1).tolist()]

    def whiten(self, rows: DataFrame, k: int, column: str = "x") -> DataFrame:
        """Adds ``whitened``, the first k components at most, and ``deviation``."""
        k = min(k, self.kept)
        names = [c for c in rows.columns if c not in ("whitened", "deviation")]
        shared = rows.sparkSession.sparkContext.broadcast((self, self.vectors[:, :k] / np.sqrt(self.values[:k])))  # dimensions squared
        at = names.index(column)

        def project(batches):
            model, turn = shared.value
            for b in batches:
                x = _matrix(b.column(at), len(model.mean))
                flat = pa.array(((x - model.mean) @ turn).ravel(), pa.float64())
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), flat)
                yield pa.RecordBatch.from_arrays([*b.columns, white, pa.array(model.deviation(x), pa.int64())], names=[*names, "whitened", "deviation"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
        return rows.select(*names).mapInArrow(project, f"{kinds}, whitened array<double>, deviation long")


def fit(distinct: DataFrame, dim: int) -> Whitening | None:
    """From the rows ``x`` of a written table of distinct vectors."""
    n, s = sums(distinct, "x", dim)
    if not n:
        return None
    v = covariance(distinct, "x", n, np.array([t / n for t in s]))
    values, vectors = np.linalg.eigh(v)
    return Whitening(n, s, values[::-1], vectors[:, ::-1], float(np.trace(v)))


def identity_error(distinct: DataFrame, model: Whitening, k: int) -> float:
    """The largest entry by which the covariance of the whitened fit list differs from the identity."""
    k = min(k, model.kept)
    white = model.whiten(distinct, k).select("whitened")
    n, s = sums(white, "whitened", k)
    return float(np.abs(covariance(white, "whitened", n, np.array(s) / n) - np.eye(k)).max())


def whitened(vectors: DataFrame, k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """The rows that take part with ``x``, ``whitened`` and ``deviation``, what was fitted, and its identity error."""
    rows = materialize(quantized(vectors), "whitening-rows")
    none = {"whitened": F.array().cast("array<double>"), "deviation": F.lit(None).cast("long")}
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return rows.withColumns(none), None, None
    rows = rows.where(F.size("x") == size.d)
    distinct = materialize(rows.select("x").distinct(), "whitening-fit")
    model = fit(distinct, size.d)
    if not model.kept:
        return rows.withColumns(none), model, None
    return model.whiten(rows, k), model, identity_error(distinct, model, k)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitened(table(spark, sf_dir, "embeddings"))
    if error is None:
        return spark.createDataFrame([], COLUMNS)
    share = F.lit((model.values[:COMPONENTS] / model.trace).tolist())
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("j", "whitened"))
    return each.select("vec_id", (F.col("j") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(share, F.col("j") + 1).alias("explained"), F.lit(error).alias("identity_error"))
