"""Whitening of embeddings: randomised range finder, Rayleigh-Ritz, full dimension where residuals fail.

Vectors become whole numbers, x = floor(64 * c) + 1000000, so counts, sums and deviations are exact. The covariance V of the
x (divisor n) is never formed at first: a pass multiplies all centred rows with an orthonormal block Q of ``k`` and some more columns
and adds up C'(CQ)/n = VQ. The first block is drawn at random; each pass gives the next block (a power pass) and, by
Rayleigh-Ritz in Q, components with their residuals |Vq - eq|. If these are not down to ``TOLERANCE`` of the greatest eigenvalue
after ``passes`` power passes, as with flat spectra, the block is filled up to the whole space and one more pass gives all components.

A task adds its rows up to one block of (dimension x columns); Spark sums the blocks entry by entry; only the sum comes
to the driver, whose size depends on the dimension alone. Rows are centred before any product, from exact n * x - S.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry go; so do entries of 2^57 and beyond, as
x has to be a long. If lengths differ, the most frequent one (of equal ones the least) is the table's dimension and others go.
There are as many components as ``k``, the dimension and the rank allow: directions whose variance is below RANK of the greatest can't be
whitened. Without spread (one row, equal rows) and for an empty table the result is empty. Repeated rows and null ids count like any
other. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_rows

SCALE, SHIFT = 64, 1_000_000
COMPONENTS, OVERSAMPLING, PASSES = 32, 16, 5
#: Residuals against the greatest eigenvalue; directions below RANK of it are none.
TOLERANCE, RANK = 1e-13, 1e-12
SEED = 12


def whole(column: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Lengths of the usable vectors of a batch (0: none), and (rows, x) for each length, or for the given one."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    usable, parts = np.zeros(len(column), np.int64), []
    for d in np.unique(lengths[lengths > 0]) if dimension is None else [dimension]:
        rows = np.flatnonzero(lengths == d)
        c = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
        good = (np.abs(c) < 2.0**57).all(axis=1)  # neither null (NaN) nor infinite
        rows = rows[good]
        usable[rows] = d
        parts.append((rows, np.floor(SCALE * c[good]).astype(np.int64) + SHIFT))
    return usable, parts


class Centre:
    """n and the sums S: centred rows and deviations from exact n * x - S."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as whole numbers: longs where these surely suffice, else numbers of any size."""
        if not x.size or self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums)) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        v = self.numerators(x)
        most = max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0
        if most * most * x.shape[1] >= 1 << 63:
            from decimal import Decimal

            return pa.array([Decimal(sum(int(a) ** 2 for a in row)) for row in v.tolist()], pa.decimal128(38, 0))
        return pa.array((v * v).sum(axis=1)).cast(pa.decimal128(38, 0))


def _summed(vectors: DataFrame, dimension: int, added: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a matrix that ``added`` gives for a batch of x: one block a task, summed entry by entry in Spark."""
    bounded_batches(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in whole(batch.column(0), dimension)[1]:
                if len(x):
                    part = added(x)
                    total = part if total is None else total + part
        if total is not None:
            listed = pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), listed], names=["i", "row"])

    blocks = vectors.mapInArrow(run, "i int, row array<double>")
    entries = blocks.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j, value = (entries[c].to_numpy() for c in ("i", "j", "value"))
    out = np.zeros((i.max() + 1, j.max() + 1))
    out[i, j] = value
    return out


def centre(vectors: DataFrame) -> tuple[int, Centre] | None:
    """The dimension and the exact centre of a one-column table of vectors; None if no vector is usable."""
    kinds = map_rows(vectors, vectors.columns, _counted, "d int, n long").groupBy("d").agg(F.sum("n").alias("n")).where("d > 0")
    most = kinds.orderBy(F.desc("n"), "d").first()
    if most is None:
        return None
    d = most["d"]

    def halves(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Sums of the high and the low halves: neither overflows."""
        ((_, x),) = whole(batch.column(0), d)[1]
        return pa.RecordBatch.from_arrays([pa.array([(x >> 32).sum(axis=0)]), pa.array([(x & 0xFFFFFFFF).sum(axis=0)])], names=["high", "low"])

    parts = map_rows(vectors, vectors.columns, halves, "high array<long>, low array<long>")
    sums = parts.select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "s")).groupBy("i").agg(*[F.sum(F.col(f"s.{c}").cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    return d, Centre(most["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in sums.orderBy("i").collect()])


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    d, n = np.unique(whole(batch.column(0))[0], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(n.astype(np.int64))], names=["d", "n"])


def components(vectors: DataFrame, d: int, about: Centre, k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Eigenvalues (falling), components (columns), the trace of V, and how many columns the last block had."""
    columns = min(d, k + oversampling)

    def multiplied(q: np.ndarray) -> np.ndarray:
        """VQ, and in the last row the trace."""

        def added(x: np.ndarray) -> np.ndarray:
            c = about.centred(x)
            trace = np.zeros((1, q.shape[1]))
            trace[0, 0] = np.einsum("ij,ij->", c, c)
            return np.concatenate((c.T @ (c @ q), trace))

        return _summed(vectors, d, added) / about.n

    def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        t = q.T @ vq
        e, u = np.linalg.eigh((t + t.T) / 2)
        e, u = e[::-1][:k], u[:, ::-1][:, :k]
        found = q @ u
        residual = np.linalg.norm(vq @ u - found * e, axis=0)
        return e, found / np.linalg.norm(found, axis=0), bool((residual <= TOLERANCE * max(e[0], 0)).all())

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, columns)))[0]
    *vq, trace = multiplied(q)
    for _ in range(passes if columns < d else 0):
        q = np.linalg.qr(np.array(vq))[0]
        *vq, trace = multiplied(q)
        e, found, good = ritz(q, np.array(vq))
        if good:
            break
    else:
        q = np.linalg.qr(np.concatenate((q, np.random.default_rng(SEED + 1).standard_normal((d, d - columns))), axis=1))[0] if columns < d else q
        *vq, trace = multiplied(q) if columns < d else (*vq, trace)
        e, found, _ = ritz(q, np.array(vq))
    good = e > RANK * max(e[0], 0)
    return e[good], found[:, good], float(trace[0]), q.shape[1]


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, oversampling: int = OVERSAMPLING, passes: int = PASSES) -> DataFrame:
    """A row for each usable vector and component: key, component, n, deviation (decimal), whitened, explained, identity_error."""
    vectors = embeddings.select(vector)
    kind = embeddings.schema[key].dataType.simpleString()
    found = centre(vectors)
    e = np.zeros(0)
    if found:
        d, about = found
        e, parts, trace, _ = components(vectors, d, about, k, oversampling, passes)
    if not len(e):
        return embeddings.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    scaled = parts / np.sqrt(e)

    def added(x: np.ndarray) -> np.ndarray:
        w = about.centred(x) @ scaled
        return np.concatenate((w.T @ w, w.sum(axis=0)[None]))

    *second, mean = _summed(vectors, d, added) / about.n
    error = float(np.abs(np.array(second) - np.outer(mean, mean) - np.eye(len(e))).max())
    explained = F.lit((e / trace).tolist())

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ((at, x),) = whole(batch.column(1), d)[1]
        w = about.centred(x) @ scaled
        each = pa.array(np.repeat(np.arange(len(at)), len(e)))
        number = np.tile(np.arange(1, len(e) + 1, dtype=np.int32), len(at))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)).take(each), pa.array(number), about.deviations(x).take(each), pa.array(w.ravel())], names=[key, "component", "deviation", "whitened"])

    out = map_rows(embeddings, [key, vector], rows, f"`{key}` {kind}, component int, deviation decimal(38,0), whitened double")
    return out.select(key, "component", F.lit(about.n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"))
